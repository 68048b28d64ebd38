"""Personal data: generators propose spans, boosted trees choose among them.

Fixed patterns give the base spans. Looser generators propose further, overlapping
spans; gradient-boosted trees score each by the features of its format and context,
and those over their kind's calibrated threshold are added. The trees learn from plants:
into pieces of the given texts, data of every loose kind is written the way people give
it, and strings of the same form are written the way texts give orders, parts and
versions. So the truth of the plants is known, and half of them, held out, set the
thresholds. DataFrame functions throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from undula.llm.shared import broadcast_if_small, checkpointed, table

BASE_KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Lookbehinds and possessive runs keep them linear on long runs and match the same text.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Looser generators; each is tried on its own, so their spans overlap.
LOOSE = {
    "email_spelled": r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,12}\b",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "digits": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
LOOSE_HINTS = {"email_spelled": r"(?:\(at\)|\[at\]| at )", "national_id": r"[0-9]-[0-9]{2}-[0-9]", "phone_local": r"[0-9]\)? ?[ -]?[0-9]{3,4}[ -][0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "digits": r"[0-9](?:[ -]?[0-9]){12}"}
KINDS = (*BASE_KINDS, *LOOSE)
#: Words near a span that speak for personal data, and characters of context looked at.
CONTEXT = {
    "contact": r"(?i)\b(?:phone|tel|telephone|mobile|cell|call|fax|contact|reach|whatsapp)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|write|contact|address)\b",
    "money": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|account|iban|bank|payment)\b",
    "person": r"(?i)\b(?:ssn|social security|passport|licen[cs]e|id|born|dob|name|patient|employee)\b",
    "other": r"(?i)\b(?:version|order|invoice|isbn|issn|serial|part|page|figure|ticket|total|price)\b",
}
AROUND = 40
#: What stands before planted personal data, by kind, and before planted strings of the same form that are none.
GIVEN = {
    "email_spelled": ("write to ", "my mail is ", "contact ", "e-mail: ", "reach me, "),
    "national_id": ("my ssn is ", "social security ", "SSN: ", "employee id ", "patient born 1971, "),
    "phone_local": ("call me, ", "phone: ", "tel. ", "mobile ", "reach us, "),
    "iban": ("iban ", "my bank account ", "payment to ", "account: "),
    "digits": ("visa ", "my card is ", "credit card: ", "debit ", "card no. "),
}
OTHERWISE = ("order ", "invoice no. ", "part ", "version ", "isbn ", "serial: ", "ticket ", "page ", "total ", "figure ")
#: Texts, by hash, that plants are written into for the fit: each gets plants of every kind, given and otherwise, and one with nothing before it.
FIT_DOCS = 600
TREES, TREE_DEPTH, SEED = 8, 3, 11
#: The share of held-out chosen plants that must be right, for each kind.
PRECISION = 0.95
#: A text is told by its id and a hash; so rows that repeat an id keep their own spans, and rows without one too.
KEY = ("doc_id", "text_hash")


def spans_of(text: Column, found: Column, pieces: Column, kind: str) -> Column:
    """An array of (kind, start, end, value, before, after) from a pattern's matches and the pieces between them."""
    places = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.char_length(F.element_at(pieces, i)) + F.char_length(F.element_at(found, i))).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + F.char_length(F.element_at(pieces, i))).alias("start"),
                    (acc["at"] + F.char_length(F.element_at(pieces, i)) + F.char_length(F.element_at(found, i))).alias("end"),
                    F.element_at(found, i).alias("value"),
                ),
            ).alias("out"),
        ),
    )["out"]
    around = lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.substring(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND))).alias("before"),
        F.substring(text, s["end"] + 1, F.lit(AROUND)).alias("after"),
    )
    return F.when(F.size(found) > 0, F.transform(places, around)).otherwise(F.array())


def candidates(docs: DataFrame) -> DataFrame:
    """(KEY, kind, start, end, value, before, after): all that the patterns and generators propose in docs (KEY, text)."""
    tried, hints = PATTERNS | LOOSE, HINTS | LOOSE_HINTS
    text = F.col("text")
    some = docs.select(*KEY, F.coalesce("text", F.lit("")).alias("text"))
    matches = some.select(*KEY, "text", *[F.when(text.rlike(hints[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"f_{k}") for k, p in tried.items()])
    held = matches.where(reduce(lambda a, b: a | b, [F.size(f"f_{k}") > 0 for k in tried]))
    cut = held.select("*", *[F.when(F.size(f"f_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in tried.items()])
    every = F.flatten(F.array(*[spans_of(text, F.col(f"f_{k}"), F.col(f"p_{k}"), k) for k in tried]))
    return cut.select(*KEY, F.explode(every).alias("s")).select(*KEY, "s.*")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)))
    return (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0) & (F.char_length(digits) > 0)


def checked(rows: DataFrame) -> DataFrame:
    """The candidates with `valid`: the kind's own check of the value, and `base`: valid and of a base kind."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length("digits")
    octets = F.forall(F.split("value", r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^[0-9]{1,3}$") & (F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255))
    valid = (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "card", n.between(16, 19) & luhn(F.col("digits")))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .when(F.col("kind") == "digits", n.between(13, 19) & luhn(F.col("digits")))
        .when(F.col("kind") == "national_id", ~F.col("digits").rlike("^(000|666|9)") & (F.substring("digits", 4, 2) != "00") & (F.substring("digits", 6, 4) != "0000"))
        .when(F.col("kind") == "iban", F.col("value").rlike("^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}") & n.between(10, 34))
        .when(F.col("kind") == "phone_local", n.between(9, 12))
        .otherwise(F.col("value").rlike(r"(?i)\b(com|org|net|edu|gov|io|de|fr|es|uk)$"))
    )
    return rows.withColumn("digits", digits).withColumn("valid", valid).withColumn("base", F.col("valid") & F.col("kind").isin(*BASE_KINDS))


def features(rows: DataFrame) -> DataFrame:
    """The checked candidates with f_ columns of doubles on their kind, format and context."""
    speaks = {k: (F.col("before").rlike(p) | F.col("after").rlike(p)) for k, p in CONTEXT.items()}
    marks = F.regexp_replace("value", "[A-Za-z0-9]", "")
    made = {f"kind_{k}": F.col("kind") == k for k in LOOSE} | {f"near_{k}": c for k, c in speaks.items()} | {
        "letters": F.col("value").rlike("[A-Za-z]"),
        "blanks": F.contains(marks, F.lit(" ")),
        "hyphens": F.contains(marks, F.lit("-")),
        "dots": F.contains(marks, F.lit(".")),
        "brackets": F.contains(marks, F.lit("(")),
        "even_groups": F.size(F.array_distinct(F.transform(F.split("value", "[^A-Za-z0-9]+"), lambda x: F.char_length(x)))) == 1,
        "zero_first": F.col("value").rlike("^0"),
        "joined_before": F.col("before").rlike("[A-Za-z0-9]$"),
        "mark_before": F.col("before").rlike("[.+#/:=_-]$"),
        "joined_after": F.col("after").rlike("^[A-Za-z0-9]"),
        "mark_after": F.col("after").rlike("^[.)/:=_-][A-Za-z0-9]"),
        "digits_near": F.col("before").rlike("[0-9][^A-Za-z0-9]{0,3}$") | F.col("after").rlike("^[^A-Za-z0-9]{0,3}[0-9]"),
    }
    return rows.select("*", *[c.cast("double").alias(f"f_{k}") for k, c in made.items()])


def planted_values(salt: Column) -> dict[str, Column]:
    """A value of each loose kind, passing its check, from hashes of the salt."""
    number = lambda i, n: F.lpad(F.pmod(F.xxhash64(salt, F.lit(i)), F.lit(10**n)).cast("string"), n, "0")
    pick = lambda i, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64(salt, F.lit(i)), F.lit(len(xs))).cast("int") + 1)
    between = lambda i, low, high: (F.pmod(F.xxhash64(salt, F.lit(i)), F.lit(high - low)) + low).cast("string")
    name = lambda i: pick(i, "anna", "b.smith", "jo_miller", "carla", "d.osei", "lee", "m.garcia", "p-huber", "rita", "tom.w")
    front = F.concat(between(20, 3, 6), number(21, 13))  # 15 digits in all: 16 to 19 are a base kind
    last = F.element_at(F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: luhn(F.concat(front, c))), 1)
    whole = F.concat(front, last)
    spaced = F.concat_ws(" ", F.substring(whole, 1, 4), F.substring(whole, 5, 6), F.substring(whole, 11, 5))
    return {
        "email_spelled": F.concat(name(1), pick(2, " (at) ", " [at] ", " at "), pick(3, "example", "mail-host", "uni", "post"), pick(4, " dot ", " (dot) ", "."), pick(5, "com", "org", "net", "de")),
        "national_id": F.concat(between(6, 100, 600), F.lit("-"), between(7, 10, 100), F.lit("-"), between(8, 1000, 10000)),
        "phone_local": F.concat(pick(9, "(", ""), between(10, 200, 1000), F.when(pick(9, "(", "") == "(", ") ").otherwise(pick(11, "-", " ")), between(12, 200, 1000), pick(11, "-", " "), between(13, 1000, 10000)),
        "iban": F.concat(pick(14, "DE", "FR", "ES", "GB"), between(15, 10, 100), F.lit(" "), F.concat_ws(" ", *[number(16 + i, 4) for i in range(4)])),
        "digits": F.when(pick(30, "spaced", "plain") == "spaced", spaced).otherwise(whole),
    }


def planted(docs: DataFrame, given: dict[str, tuple[str, ...]] = GIVEN, otherwise: tuple[str, ...] = OTHERWISE, fit_docs: int = FIT_DOCS) -> DataFrame:
    """The loose candidates (with their features) that are plants, `label` 1 where the plant is given as personal data, and a hash `_h`.

    Plants go into pieces of at most fit_docs of docs, those with the smallest hashes.
    What stands before a plant, and which value it has, is told by hashes too.
    """
    drawn = docs.where(F.char_length("text") > 0).withColumn("_o", F.xxhash64(*KEY, F.lit(SEED))).orderBy("_o", *KEY).limit(fit_docs)
    at = F.pmod(F.col("_o"), F.char_length("text"))
    drawn = drawn.select("_o", F.substring("text", F.greatest(at - AROUND, F.lit(0)) + 1, F.lit(AROUND)).alias("l"), F.substring("text", at + 1, F.lit(2 * AROUND)).alias("r"))
    plants = []
    for i, kind in enumerate(LOOSE):
        for j, (phrases, label) in enumerate(((given[kind], 1.0), (given[kind], 1.0), (otherwise, 0.0), (otherwise, 0.0), (("",), 1.0), (("",), 0.0))):
            salt = F.xxhash64("_o", F.lit(10 * i + j))
            phrase = F.element_at(F.array(*[F.lit(p) for p in phrases]), F.pmod(F.xxhash64(salt, F.lit(99)), F.lit(len(phrases))).cast("int") + 1)
            plants.append(F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), phrase.alias("phrase"), planted_values(salt)[kind].alias("value"), salt.alias("_h")))
    each = drawn.select("l", "r", F.explode(F.array(*plants)).alias("p"))
    texts = each.select(F.col("p._h").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"), F.concat("l", F.lit(" "), F.col("p.phrase"), F.col("p.value"), F.lit(" "), "r").alias("text"), F.col("p.kind").alias("_kind"), F.col("p.value").alias("_value"), F.col("p.label").alias("label"), F.char_length("l").alias("_from"))
    texts = checkpointed(texts)
    found = features(checked(candidates(texts))).where("valid and not base")
    mine = texts.select("doc_id", "_kind", "_value", "label", "_from")
    hit = (F.col("kind") == F.col("_kind")) & F.contains("value", F.col("_value")) & (F.col("start") >= F.col("_from"))
    return found.join(mine, "doc_id").where(hit).withColumn("_h", F.xxhash64("doc_id", F.lit(1))).drop("_kind", "_value", "_from")


def calibrated_thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[str, float]:
    """For each kind the lowest score, in hundredths, from which on the held-out rows are right in at least that share; kinds without one are absent."""
    bins = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).orderBy("kind", F.desc("bin")).collect()
    best: dict[str, float] = {}
    sums: dict[str, tuple[float, int]] = {}
    for r in bins:  # at most 101 rows a kind
        right, n = sums.get(r["kind"], (0.0, 0))
        right, n = sums[r["kind"]] = right + r["right"], n + r["n"]
        if right >= precision * n:
            best[r["kind"]] = r["bin"] / 100
    return best


class Chooser:
    """Boosted trees fitted on half of the plants, and a threshold for each kind from the other half."""

    def __init__(self, plants: DataFrame, precision: float = PRECISION):
        plants = checkpointed(plants.drop("before", "after", "value", "digits").withColumn("_half", F.pmod(F.xxhash64("_h"), F.lit(2))))
        self.vector = VectorAssembler(inputCols=[c for c in plants.columns if c.startswith("f_")], outputCol="features")
        fit = self.vector.transform(plants.where("_half = 0"))
        self.thresholds: dict[str, float] = {}
        if fit.select("label").distinct().limit(2).count() == 2:
            self.model = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, seed=SEED, cacheNodeIds=False).fit(fit)
            self.thresholds = calibrated_thresholds(self.scored(plants.where("_half = 1")), precision)

    def scored(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.vector.transform(rows)).withColumn("score", vector_to_array("probability")[1])

    def chosen(self, rows: DataFrame) -> DataFrame:
        """The rows of loose kinds that score over their kind's threshold, with `score`."""
        if not self.thresholds:
            return rows.where(F.lit(False)).withColumn("score", F.lit(0.0))
        least = F.element_at(F.create_map(*[F.lit(x) for pair in self.thresholds.items() for x in pair]), F.col("kind"))
        return self.scored(rows).where(F.coalesce(F.col("score") >= least, F.lit(False)))


def keyed(docs: DataFrame) -> DataFrame:
    """(KEY, text) of docs, a null text being an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.char_length(text)).alias("text_hash"), text.alias("text"))


def clear_spans(spans: DataFrame) -> DataFrame:
    """spans (KEY, start, end, base) without those that are not base and touch a base span, told in one pass over a text's spans."""
    by = Window.partitionBy(*KEY).orderBy("start")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    upcoming = F.min(F.when(F.col("base"), F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    told = spans.withColumn("_reached", reached).withColumn("_next", upcoming)
    touches = F.coalesce(F.col("_reached") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    return told.where(F.col("base") | ~touches).drop("_reached", "_next")


def find_pii(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, text_hash, spans): kind, start, end (exclusive, in code points), base and score of every span chosen.

    Needs doc_id and text; other columns are not read. One row is returned for each row
    of docs; a null text is an empty one. A row's spans are those of its own text, also
    where rows repeat an id or have none. Base spans always stay. Added spans are of the
    loose kinds, pass their kind's check, score over its threshold, and are clear of base
    spans. An empty table gives no rows. The trees are fitted on plants in at most
    fit_docs of the texts, half of which calibrate the thresholds; where no text is left
    to plant in, none is added.
    """
    texts = keyed(docs)
    rows = checkpointed(features(checked(candidates(texts))).drop("before", "after", "digits", "value").distinct())
    base = rows.where("base").select(*KEY, "kind", "start", "end", "base", F.lit(None).cast("double").alias("score"))
    loose = Chooser(planted(texts, fit_docs=fit_docs)).chosen(rows.where(F.col("valid") & F.col("kind").isin(*LOOSE)))
    every = clear_spans(base.unionByName(loose.select(*KEY, "kind", "start", "end", "base", "score")))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("order")
    spans = every.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "kind", "base", "score"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    held = broadcast_if_small(checkpointed(spans.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})), 200_000, F.size("spans"))
    joined = texts.select(*KEY).join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(*KEY, F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """docs with every chosen span replaced by its kind in angle brackets, overlapping spans together; each row by the spans of its own text."""
    spans = find_pii(docs, fit_docs).dropDuplicates([*KEY]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"))
    by_place = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = F.aggregate(F.coalesce(by_place, F.array().cast("array<struct<start:int,end:int,kind:string>>")), start, step)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text, F.char_length(text)) == F.col("_hash"))
    joined = docs.join(spans, same, "left").withColumn("_done", done)
    return joined.withColumn("text", F.concat(F.col("_done.out"), F.substring(text, F.col("_done.at") + 1, F.char_length(text)))).select(docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
