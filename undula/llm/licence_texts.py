"""Known licence texts and standard notices. Fixed values."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""

_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Licence names, as SPDX has them, and the texts that are entire statements of each.
KNOWN = {
    "MIT": [
        f"MIT License\n\n{_MIT_GRANT}\n\n{_MIT_WARRANTY}",
        f"The MIT License (MIT)\n\n{_MIT_GRANT}\n\n{_MIT_WARRANTY}",
        f"{_MIT_GRANT}\n\n{_MIT_WARRANTY}",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This work is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        f"ISC License\n\n{_ISC_GRANT}\n\n{_ISC_WARRANTY}",
        f"{_ISC_GRANT}\n\n{_ISC_WARRANTY}",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_WARRANTY}",
        f"{_BSD_GRANT}\n\n{_BSD_WARRANTY}",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}",
        f"{_BSD_GRANT}\n\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Zlib": [f"zlib License\n\n{_ZLIB}", _ZLIB, "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "Apache-2.0": [
        _APACHE_NOTICE,
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        _GPL3_NOTICE,
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

#: Canonical digests (licences.digest) of full licence texts: entire, and where they have an appendix on how
#: to apply them, also up to END OF TERMS AND CONDITIONS, with that line and without.
KNOWN_DIGESTS = {
    "Apache-2.0": [
        "4bc3c949c895ead14c0dc8c6e33fd6ed118359acaad7c084c4d563cd526a878d",
        "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87",
        "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166",
    ],
    "Artistic-1.0-Perl": [
        "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    ],
    "BSD-3-Clause": [
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd",
    ],
    "GFDL-1.3": [
        "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd",
    ],
    "GPL-1.0": [
        "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
        "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",
        "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0",
    ],
    "GPL-2.0": [
        "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
        "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0",
        "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef",
    ],
    "GPL-3.0": [
        "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8",
        "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b",
        "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153",
    ],
    "LGPL-2.0": [
        "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
        "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",
        "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c",
    ],
    "LGPL-2.1": [
        "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
        "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",
        "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    ],
    "MPL-2.0": [
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ],
}

#: The lengths of the texts of KNOWN_DIGESTS in canonical words, in the same order.
KNOWN_LENGTHS = {
    "Apache-2.0": [1596, 1419, 1414],
    "Artistic-1.0-Perl": [983],
    "BSD-3-Clause": [214],
    "CC0-1.0": [1088],
    "GFDL-1.2": [3315],
    "GFDL-1.3": [3732],
    "GPL-1.0": [2067, 1641, 1636],
    "GPL-2.0": [2975, 2504, 2499],
    "GPL-3.0": [5684, 5241, 5236],
    "LGPL-2.0": [4200, 3865, 3860],
    "LGPL-2.1": [4401, 4065, 4060],
    "LGPL-3.0": [1231],
    "MPL-1.1": [3757],
    "MPL-2.0": [2414],
}
