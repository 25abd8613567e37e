"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators propose spans with high recall: the four base kinds by their strict
patterns, and further candidates of the same kinds written in other ways
(spelled-out e-mail addresses, IPv6 addresses, grouped or short card numbers, phone numbers
without a plus sign).  Boosted trees judge the further candidates by format and
context; a threshold calibrated on held-out candidates selects which are
added.  Base spans always stay; an added span never overlaps a chosen one.

Labels of the trees come from the table itself.  Every accepted base span is
rewritten into the other ways of writing its kind (a positive example in its
true context); digit and dot strings that fail the checks of their kind, with
their contexts, are the negative examples.  The fit and the thresholds take all of
them: examples of equal features are one weighted row.

Defined results: null and empty texts have no spans; rows that repeat are judged
alike; an empty table gives no rows and needs no model; columns other than
doc_id and text are ignored (kept by ``redact``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base kinds, fixed values.  Possessive quantifiers and the guard
# against a start inside a run find the same leftmost matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a run that is not 16 to 19 digits long fails anyway, so only such runs are proposed
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Cheap tests that a text can hold a kind at all.
MAY = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

# Further ways to write the kinds.
SPELLED = (r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9_%+-]{1,64}+){0,4}"
           r"\x20?[\[({<](?:at|@)[\])}>]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({<](?:dot|\.)[\])}>]\x20?)[A-Za-z0-9-]{1,63}+){1,5}")
IPV6 = (r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?=[0-9A-Fa-f:]{0,36}?::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")
GROUPED = r"(?<![0-9A-Za-z.])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2}[\x20._/-]{1,2}[0-9]{1,7}(?![0-9A-Za-z])"
LOCAL = (r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[\x20.-]?|1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"
         r"(?![0-9A-Za-z])")
FURTHER = {"email": SPELLED, "ip": IPV6, "card": GROUPED, "phone": LOCAL}
FURTHER_MAY = {"email": r"(?i)[\[({<](?:at|@)[\])}>]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9]{4}[\x20._/-]{1,2}[0-9]{4}",
               "phone": r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"}

#: Characters before and after a candidate that the context features see.
CONTEXT = 48
CUES = {
    "email": r"(?i)mail|contact|write|reach|adress|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login|log|from",
    "card": r"(?i)card|visa|master|amex|credit|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|fax|mobil|cell|whatsapp|contact",
}
AGAINST = r"(?i)version|isbn|issn|order|invoice|build|release|section|chapter|serial|part\sno|ticket|doi|rfc|page"

ROUNDS, DEPTH = 12, 3
#: Least precision on held-out candidates at the chosen threshold.
PRECISION = 0.95
SEED = 17

FEATURES = ["kind_no", "chars", "digits", "digit_share", "letters", "groups", "symbols", "luhn", "cue", "against",
            "before_word", "after_word", "before_digit", "after_digit", "brackets", "distinct_digits"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    doubled = F.lit("0246813579")
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, F.substr(doubled, d + 1, F.lit(1)).cast("int")).otherwise(d)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # a part of more digits than a long holds is over 255 too
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    n = F.length(digits_of(match))
    if kind == "card":
        return n.between(16, 19) & luhn(digits_of(match))
    return n.between(8, 15)


def matches(found: Column, gaps: Column) -> Column:
    """Array of (start, end, span, before, after): matches with code point places and contexts.

    ``found`` and ``gaps`` are the matches and the pieces between them, both from
    the same left-to-right scan of the whole text; lengths add up to places.
    """
    kind = "struct<start:long,end:long,span:string,before:string,after:string>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        gap, span, rest = F.get(gaps, i), F.get(found, i), F.get(gaps, i + 1)
        start = acc["at"] + F.length(gap)
        end = start + F.length(span)
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), span.alias("span"),
                       F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(rest, F.lit(CONTEXT)).alias("after"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))
    places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, zero, step, lambda acc: acc["spans"])


_CANDIDATES = ("array<struct<kind_no:int,start:long,end:long,span:string,before:string,after:string,"
               "base:boolean,ok:boolean>>")


def _candidate(no: int, kind: str, base: bool):
    """The function that turns a match of a pattern into a candidate."""
    def made(m: Column) -> Column:
        ok = valid(kind, m["span"]) if base else F.lit(False)
        return F.struct(F.lit(no).alias("kind_no"), *[m[c].alias(c) for c in ("start", "end", "span", "before", "after")],
                        F.lit(base).alias("base"), ok.alias("ok"))
    return made


def with_candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Adds the array of all proposed spans: kind_no, start, end, span, before, after, base, ok."""
    df, parts, own = docs, [], []
    for base, patterns, may in ((True, BASE, MAY), (False, FURTHER, FURTHER_MAY)):
        for no, kind in enumerate(KINDS):
            found = f"__{'base' if base else 'further'}_{kind}"
            gaps = found + "_gaps"
            own += [found, gaps]
            can = F.col(text).rlike(may[kind])
            df = df.withColumn(found, F.when(can, F.regexp_extract_all(F.col(text), F.lit(patterns[kind]), F.lit(0))))
            df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), patterns[kind], -1)))
            spans = F.when(F.col(gaps).isNotNull(), matches(F.col(found), F.col(gaps)))
            parts.append(F.coalesce(F.transform(spans, _candidate(no, kind, base)), F.array().cast(_CANDIDATES)))
    return df.withColumn(out, F.concat(*parts)).drop(*own)


def features(kind_no: Column, span: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate; depends on nothing else."""
    digits = digits_of(span)
    n = F.length(span)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    cue = reduce(lambda rest, k: F.when(kind_no == KINDS.index(k), before.rlike(CUES[k])).otherwise(rest),
                 KINDS, F.lit(False))
    found = {
        "kind_no": kind_no, "chars": n, "digits": F.length(digits),
        "digit_share": F.length(digits) / F.greatest(n, F.lit(1)),
        "letters": F.length(F.regexp_replace(span, "[^A-Za-z]", "")),
        "groups": F.size(F.split(span, r"[^0-9A-Za-z]+")),
        "symbols": F.length(F.regexp_replace(span, r"[0-9A-Za-z\x20]", "")),
        "luhn": flag(luhn(digits)), "cue": flag(cue), "against": flag(before.rlike(AGAINST)),
        "before_word": flag(before.rlike(r"[A-Za-z]\x20?$")), "after_word": flag(after.rlike(r"^\x20?[A-Za-z]")),
        "before_digit": flag(before.rlike(r"[0-9]\W?$")), "after_digit": flag(after.rlike(r"^\W?[0-9]")),
        "brackets": F.length(F.regexp_replace(span, r"[^()\[\]{}<>]", "")),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
    }
    return {k: F.coalesce(found[k].cast("double"), F.lit(0.0)) for k in FEATURES}


def rewritten(kind_no: Column, span: Column) -> Column:
    """Other ways to write a base span, as an array."""
    digits = digits_of(span)
    group = lambda sep: F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", f"$1{sep}")
    local = F.right(digits, F.lit(10))
    phone = lambda shape: F.regexp_replace(local, r"^([0-9]{3})([0-9]{3})([0-9]{4})$", shape)
    at = lambda a, dot: F.regexp_replace(F.regexp_replace(span, "@", a), r"\.", dot)
    hexes = F.transform(F.split(span, r"\."), lambda p: F.lower(F.hex(p.cast("long"))))
    ways = {
        "email": F.array(at(" (at) ", "."), at("[at]", "[dot]"), at(" [at] ", " [dot] ")),
        "ip": F.array(F.concat(F.lit("2001:db8::"), F.array_join(hexes, ":")),
                      F.concat(F.lit("fe80:0:0:0:"), F.array_join(hexes, ":"))),
        "card": F.array(group("."), group("/"), group("  ")),
        "phone": F.array(phone("($1) $2-$3"), phone("$1-$2-$3"), phone("$1 $2 $3")),
    }
    return reduce(lambda rest, k: F.when(kind_no == KINDS.index(k), ways[k]).otherwise(rest),
                  KINDS, F.array().cast("array<string>"))


def examples(candidates: DataFrame) -> DataFrame:
    """All labelled rewritten candidates: a row for each label, place and feature vector, ``weight`` the examples that have it."""
    base = candidates.select(F.explode(F.filter("candidates", lambda c: c["base"])).alias("c"))
    rows = base.select(F.col("c.ok").alias("ok"), F.col("c.kind_no").alias("kind_no"), F.col("c.before").alias("before"),
                       F.col("c.after").alias("after"), F.explode(rewritten(F.col("c.kind_no"), F.col("c.span"))).alias("span"))
    rows = rows.dropna(subset=["span"]).distinct()
    rows = rows.withColumn("place", F.pmod(F.xxhash64("kind_no", "span", "before", "after"), F.lit(4)))
    made = features(*[F.col(c) for c in ("kind_no", "span", "before", "after")])
    return (rows.select(F.col("ok").cast("double").alias("label"), "place", *[c.alias(k) for k, c in made.items()])
            .groupBy("label", "place", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")))


class Judge:
    """The boosted trees as a column expression, with a threshold for each kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, found: dict[str, Column]) -> Column:
        def value(node) -> Column:
            if node[0] == "leaf":
                return F.lit(float(node[1]))
            _, name, threshold, left, right = node
            return F.when(found[name] <= threshold, value(left)).otherwise(value(right))
        margin = reduce(lambda a, b: a + b, [value(t) * w for t, w in zip(self.trees, self.weights, strict=True)], F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def threshold(self, kind_no: Column) -> Column:
        return reduce(lambda rest, k: F.when(kind_no == KINDS.index(k), F.lit(self.thresholds[k])).otherwise(rest),
                      KINDS, F.lit(2.0))


def _tree(node) -> tuple:
    if node.getClass().getSimpleName() == "LeafNode":
        return ("leaf", node.prediction())
    split = node.split()
    return ("split", FEATURES[split.featureIndex()], split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def fit(candidates: DataFrame, precision: float = PRECISION) -> Judge:
    """Fit on three quarters of the examples, calibrate thresholds on the rest.

    A kind's threshold is the least score at which held-out examples of that
    kind are right with ``precision``; a kind without positive held-out examples adds nothing.
    """
    rows = written(examples(candidates), "pii-examples")
    if {r[0] for r in rows.where("place > 0").select("label").distinct().collect()} != {0.0, 1.0}:
        return Judge([], [], dict.fromkeys(KINDS, 2.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(vectors.where("place > 0"))
    held = model.transform(vectors.where("place = 0")).select(
        "kind_no", "label", "weight", F.floor(vector_to_array("probability")[1] * 50).alias("step"))
    steps = held.groupBy("kind_no", "step").agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("all")).collect()
    thresholds = {}
    for no, kind in enumerate(KINDS):
        own = sorted(((r["step"], r["right"], r["all"]) for r in steps if r["kind_no"] == no), reverse=True)
        best, right, total = 2.0, 0.0, 0
        for step, r, n in own:
            right, total = right + r, total + n
            if right and right >= precision * total:
                best = step / 50
        thresholds[kind] = max(best, 0.5)
    trees = [_tree(t._java_obj.rootNode()) for t in model.trees]
    return Judge(trees, list(model.treeWeights), thresholds)


def chosen(candidates: Column, judge: Judge) -> Column:
    """Array of (kind_no, start, end, base): base spans, and the added ones in order of their scores."""
    def span(c: Column, base: bool, score: Column) -> Column:
        return F.struct(c["kind_no"].alias("kind_no"), c["start"].alias("start"), c["end"].alias("end"),
                        F.lit(base).alias("base"), score.alias("score"))
    base = F.transform(F.filter(candidates, lambda c: c["base"] & c["ok"]), lambda c: span(c, True, F.lit(1.0)))
    if not judge.trees:
        return base

    def scored(c: Column) -> Column:
        return span(c, False, judge.score(features(c["kind_no"], c["span"], c["before"], c["after"])))
    further = F.filter(F.transform(F.filter(candidates, lambda c: ~c["base"]), scored),
                       lambda c: c["score"] >= judge.threshold(c["kind_no"]))
    apart = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    ranked = F.array_sort(further, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                          .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                          .otherwise(a["kind_no"] - b["kind_no"]))
    return F.aggregate(ranked, base, lambda acc, c: F.when(F.forall(acc, lambda x: apart(x, c)), F.concat(acc, F.array(c)))
                       .otherwise(acc))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind_no, start, end, base, score), by kind, then start."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    candidates = written(with_candidates(rows).drop("text"), "pii-candidates")
    return candidates.select("doc_id", F.array_sort(chosen(F.col("candidates"), fit(candidates))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; n_chars, if there, follows.

    The model is fitted to a first pass; the second proposes, judges and
    replaces in place, so that no text is shuffled.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    judge = fit(written(with_candidates(rows).select(F.filter("candidates", lambda c: c["base"]).alias("candidates")),
                        "pii-candidates"))
    spans = F.transform(chosen(F.col("__candidates"), judge),
                        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind_no"].alias("kind_no")))
    df = with_candidates(docs, out="__candidates").withColumn("__spans", F.array_sort(spans))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def step(acc: Column, c: Column) -> Column:
        gap = F.substr(text, acc["at"].cast("int") + 1, (c["start"] - acc["at"]).cast("int"))
        put = F.concat(acc["out"], gap, F.get(tags, c["kind_no"]))
        inside = c["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(put).alias("out"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col("__spans"), zero, step,
                        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, F.length(text))))
    df = df.withColumn("__text", F.when(F.size("__spans") > 0, clean).otherwise(text))
    out = {"text": F.col("__text"), "n_chars": F.when(F.size("__spans") > 0, F.length("__text").cast("long"))
           .otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[out[c].alias(c) if out.get(c) is not None else F.col(c) for c in docs.columns])
