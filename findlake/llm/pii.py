"""Personal data: strict patterns, wide candidate generators, and boosted trees that choose among the candidates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.shared import content_key, give_back, materialise, unused
from findlake.llm.spans import SPAN, find_spans, merged, no_spans, redact

# The kinds of strict spans in their order, and the kinds of what the trees add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("mail_like", "mail_said", "number_like", "digits_like")

#: MLlib looks at all rows for the thresholds of its trees up to the square of so many; a task holds so many rows.
MOST_BINS, ROWS_A_TASK = 4096, 20_000

#: Stands for a character inside a run (a dot inside a domain, a separator between digits), so that runs need no loop
#: over a group: such loops recurse in the regular-expression library and overflow on long runs.
_JOINT, _OTHER = "", ""

# A run that starts after another match, or after a character that could not belong to it: the same matches as without,
# but a failed run is not tried again from each of its characters.
_EMAIL = rf"(?:(?<![A-Za-z0-9._%+{_JOINT}-])|\G)[A-Za-z0-9._%+{_JOINT}-]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
_CARD = rf"[0-9][0-9{_JOINT}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wide generators. Runs have no upper length: possessive or of single characters, and started at their first character only.
_MAIL_LIKE = r"(?<![^\s@<>()\[\],;:\"'])[^\s@<>()\[\],;:\"']++@[^\s@<>()\[\],;:\"']++"
_SAID = r"(?:\x20++|\x20*+[\[(]\x20*+){word}(?:\x20++|\x20*+[\])]\x20*+)[A-Za-z0-9-]++"
_MAIL_SAID = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _SAID.format(word="(?i:at)") + _SAID.format(word="(?i:dot)") + "(?:" + _SAID.format(word="(?i:dot)") + "){0,2}+"
_NUMBER_LIKE = r"(?<![0-9])[+(]?[0-9][0-9\x20().-]*[0-9](?![0-9])"
_DIGITS_LIKE = r"(?<![0-9A-Za-z])[0-9]{7,}+(?![A-Za-z])"
#: Words before a span that say what it is.
_HINT = r"(?:^|[^a-z])(?:e-?mail|mail|tel|telephone|phone|call|fax|mobile|card|visa|account|contact)[^a-z]*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check digit."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), part), F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def strict_spans(text: Column) -> Column:
    """Spans of the strict kinds, by kind and then start. Replacements keep every place in the text."""
    plain = F.translate(text, _JOINT, _OTHER)
    dots = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOINT)
    email = F.when(F.contains(text, F.lit("@")), find_spans(dots, _EMAIL, "email", 0)).otherwise(no_spans())
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), find_spans(text, _IP, "ip", 1, _octets)).otherwise(no_spans())
    runs = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", _JOINT)
    is_card = lambda m: F.when(_between(F.length(F.translate(m, _JOINT, "")), 16, 19), luhn(F.translate(m, _JOINT, ""))).otherwise(False)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), find_spans(runs, _CARD, "card", 2, is_card)).otherwise(no_spans())
    phone = F.when(F.contains(text, F.lit("+")), find_spans(text, _PHONE, "phone", 3, lambda m: _between(F.length(_digits(m)), 8, 15))).otherwise(no_spans())
    return F.concat(email, ip, card, phone)


def wide_spans(text: Column) -> Column:
    """Proposals of the wide generators, which may overlap strict spans and each other: anything around an @, "name at
    host dot com", digits with separators, and each run of digits alone."""
    at, none = F.contains(text, F.lit("@")), no_spans()
    mail = F.when(at, find_spans(text, _MAIL_LIKE, ADDED[0], 4)).otherwise(none)
    said = F.when(text.rlike(r"(?i)[\x20)\]]dot[\x20(\[]"), find_spans(text, _MAIL_SAID, ADDED[1], 5)).otherwise(none)
    number = F.when(text.rlike("[0-9][0-9\\x20().-]{5}"), find_spans(text, _NUMBER_LIKE, ADDED[2], 6, lambda m: F.length(_digits(m)) >= 7)).otherwise(none)
    digits = F.when(text.rlike("[0-9]{7}"), find_spans(text, _DIGITS_LIKE, ADDED[3], 7)).otherwise(none)
    return F.concat(mail, said, number, digits)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


FEATURES = ("mail", "length", "digits", "separators", "groups", "dots", "hyphens", "plus", "paren", "at_domain_dots", "luhn", "octets", "upper", "said", "word_before", "word_after", "hint", "date_like", "longest_group")


def _level(n: Column) -> Column:
    """A count up to 64, and above that its eighth of an octave, so that spans have few different features."""
    return F.when(n <= 64, n).otherwise(64 + F.floor(8 * (F.log2(n) - 6)))


def _features(rows: DataFrame) -> DataFrame:
    """Format and context of a span (columns kind, value, before, after) as numbers."""
    v, digits = F.col("value"), _digits(F.col("value"))
    pieces = F.filter(F.split(v, "[^0-9]+"), lambda p: F.length(p) > 0)
    made = {
        "mail": F.col("kind").isin("email", *ADDED[:2]),
        "length": _level(F.length(v)),
        "digits": _level(F.length(digits)),
        "separators": _level(F.length(F.regexp_replace(v, r"[^\x20-]", ""))),
        "groups": _level(F.size(pieces)),
        "dots": _level(F.length(F.regexp_replace(v, r"[^.]", ""))),
        "hyphens": _level(F.length(F.regexp_replace(v, "[^-]", ""))),
        "plus": F.startswith(v, F.lit("+")),
        "paren": F.contains(v, F.lit("(")),
        "at_domain_dots": _level(F.length(F.regexp_replace(F.substring_index(v, "@", -1), r"[^.]", ""))),
        "luhn": F.when(_between(F.length(digits), 12, 19), luhn(digits)).otherwise(False),
        "octets": _octets(v),
        "upper": _level(F.length(F.regexp_replace(v, "[^A-Z]", ""))),
        "word_before": F.col("before").rlike(r"[A-Za-z0-9]$"),
        "word_after": F.col("after").rlike("^[A-Za-z0-9]"),
        "hint": F.lower("before").rlike(_HINT),
        "said": v.rlike(r"(?i)[\x20)\]]dot[\x20(\[]"),
        "date_like": v.rlike(r"^[12][0-9]{3}[-.][0-9]{2}[-.][0-9]{2}"),
        "longest_group": _level(F.coalesce(F.array_max(F.transform(pieces, F.length)), F.lit(0))),
    }
    return rows.withColumns({f"f_{k}": F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in made.items()})


def _by_span(order: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.struct(start.alias("start"), order.alias("order"), end.alias("end"), kind.alias("kind"))


def _loosened(strict: DataFrame) -> DataFrame:
    """Strict spans as people write them to evade a pattern, or at home: a mail address in words or without its last part,
    a phone number without + and its first group. They teach the trees forms that no strict pattern has."""
    v = F.col("value")
    local, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    said = F.when(F.crc32("value") % 2 == 0, F.concat(local, F.lit(" at "), F.regexp_replace(host, r"\.", " dot "))).otherwise(F.concat(local, F.lit("(at)"), F.regexp_replace(host, r"\.", "(dot)")))
    mails = strict.where("kind = 'email'").withColumn("value", said)
    phones = strict.where("kind = 'phone'").withColumn("value", F.trim(F.regexp_replace(v, r"^\+[0-9]++", "")))
    return mails.union(phones.where(F.length(_digits(F.col("value"))) >= 7))


def _form(value: Column) -> Column:
    """The form of a value: every digit as 9, and of a mail address in words every name as a."""
    return F.when(value.rlike(r"(?i)[\x20)\]]dot[\x20(\[]"), F.regexp_replace(F.lower(value), r"(?!\b(?:at|dot)\b)\b[a-z0-9._%+-]++", "a")).otherwise(F.regexp_replace(value, "[0-9]", "9"))


def find_personal_data(docs: DataFrame, trees: int = 12, depth: int = 4, precision: float = 0.95, least: float = 0.5) -> DataFrame:
    """(doc_id, rid, spans): for every row of docs its spans of personal data, by kind and then start.

    Strict patterns (email, ip, card, phone) are always kept. Wide generators propose further spans with high recall,
    which may overlap. Gradient-boosted trees over format and context features score every proposal apart from strict
    spans. Labels come from evidence, not from the proposals' own generator: strict spans and loosened forms of them
    (`_loosened`) are personal data; proposals without a strict span, without a word before them that says what they
    are, without a valid check digit and not of a loosened form are not; the others, on which the evidence is open, are
    not learnt from. All labelled spans count: those of equal features are one row, weighted by their number. Trees are
    fitted on seven tenths of the documents, by a hash of their content; on all labelled spans of the rest a threshold is
    set for each family of kinds (mail, number): the lowest score, of `least` or more, from which on `precision` of the
    labelled spans are personal data. Proposals from there on are added, of overlapping ones the best (ties: the first,
    then the longest). Only built-in functions and MLlib are used.

    A null text counts as empty; it has no spans. If the corpus lacks strict spans, or proposals apart from them, there
    are no trees and nothing is added. Rows equal in doc_id and text share their spans, and each comes out. Other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rid", content_key())
    around = lambda spans: F.transform(spans, lambda s: F.struct(s.alias("span"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("value"), F.substring(F.col("text"), F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"), F.substring(F.col("text"), s["end"] + 1, 8).alias("after")))
    found = rows.withColumn("strict", strict_spans(F.col("text"))).withColumn("wide", wide_spans(F.col("text")))
    found = materialise(found.select("doc_id", "rid", around(F.col("strict")).alias("strict"), around(F.col("wide")).alias("wide")), "spans")

    apart = F.filter("wide", lambda w: ~F.exists(F.col("strict"), lambda s: _overlaps(w["span"], s["span"])))
    one = found.dropDuplicates(["rid"]).where("size(strict) > 0 or size(wide) > 0")
    shape = ["rid", "span.*", "value", "before", "after"]
    positive = one.select("rid", F.explode("strict").alias("c")).select("rid", "c.*").select(*shape)
    wide = one.select("rid", F.explode(apart).alias("c")).select("rid", "c.*").select(*shape)
    digits = _digits(F.col("value"))
    open_case = F.lower("before").rlike(_HINT) | (_between(F.length(digits), 13, 19) & luhn(digits))
    # every labelled span is learnt from: those of equal features are one row with their number as its weight
    columns = [f"f_{k}" for k in FEATURES]
    fitted = (F.pmod(F.xxhash64("rid"), F.lit(10)) < 7).alias("fitted")
    counted = lambda df, *by: _features(df).groupBy(*columns, fitted, *by).agg(F.count("*").cast("double").alias("weight"))
    loosened = _loosened(positive)
    forms = loosened.select(_form(F.col("value")).alias("form")).distinct()
    plain = counted(wide.where(~open_case), _form(F.col("value")).alias("form")).join(forms, "form", "left_anti").drop("form")
    labelled = counted(positive.union(loosened)).withColumn("label", F.lit(1.0)).union(plain.withColumn("label", F.lit(0.0)))
    labelled = materialise(labelled.groupBy(*columns, "fitted", "label").agg(F.sum("weight").alias("weight")), "labelled")
    sizes = {r["label"]: r["count"] for r in labelled.where("fitted").groupBy("label").count().collect()}
    spans = F.array_sort(F.transform("strict", lambda c: c["span"]))
    kept = found.select("doc_id", "rid", spans.alias("strict"))
    if len(sizes) < 2:
        chosen = None
    else:
        vector = VectorAssembler(inputCols=columns, outputCol="features")
        trainer = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=MOST_BINS, seed=3)
        model = trainer.fit(vector.transform(labelled.where("fitted")).coalesce(-(-sum(sizes.values()) // ROWS_A_TASK)))
        give_back(docs.sparkSession)  # the plans of the trees' many short jobs
        score = lambda df: model.transform(vector.transform(df)).withColumn("score", vector_to_array("probability")[1])
        limits = _thresholds(score(labelled.where("not fitted")).groupBy((F.col("f_mail") > 0).alias("mail"), F.round("score", 3).alias("score")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).collect(), precision, least)
        # a row for each of the two families of kinds
        likely = score(_features(wide)).where(F.col("score") >= F.when(F.col("f_mail") > 0, limits[True]).otherwise(limits[False]))
        best = likely.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 6)).alias("rank"), "start", (-F.col("end")).alias("longer"), "order", "end", "kind"))).alias("c"))
        add = lambda acc, c: F.when(F.exists(acc, lambda s: _overlaps(s, c)), acc).otherwise(F.concat(acc, F.array(_by_span(c["order"], c["start"], c["end"], c["kind"]))))
        chosen = best.select("rid", F.aggregate("c", no_spans(), add).alias("added"))
    both = F.col("strict") if chosen is None else F.concat("strict", F.coalesce("added", F.array().cast(SPAN)))
    by_kind = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: _by_span(s["order"], s["start"], s["end"], s["kind"]))
    return (kept if chosen is None else kept.join(chosen, "rid", "left")).select("doc_id", "rid", by_kind.alias("spans"))


def _thresholds(rows: list, precision: float, least: float) -> dict[bool, float]:
    """For each family the lowest score from which on the share of strict spans is at least `precision`; above 1 if there is none."""
    limits = {True: 2.0, False: 2.0}
    for mail in limits:
        good = total = 0.0
        for r in sorted((r for r in rows if r["mail"] == mail), key=lambda r: -r["score"]):
            good, total = good + r["good"], total + r["all"]
            if r["score"] >= least and good >= precision * total:
                limits[mail] = float(r["score"]) - 0.0005
    return limits


def redact_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each span of personal data in `text` replaced by its kind in brackets; overlapping spans by one.
    All columns and rows stay, whatever they are called; a null text stays null."""
    key, rid, spans = (unused(docs, f"pii {name}") for name in ("key", "rid", "spans"))
    found = find_personal_data(docs, **options).select("rid", "spans").dropDuplicates(["rid"]).where("size(spans) > 0").select(F.col("rid").alias(rid), F.col("spans").alias(spans))
    joined = docs.withColumn(key, content_key()).join(found, F.col(key) == F.col(rid), "left")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redact(F.col("text"), merged(F.col(spans))))
    return joined.withColumn("text", clean).select(*[f"`{c}`" for c in docs.columns])
