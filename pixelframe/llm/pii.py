"""Personal data: rule spans, and candidates judged by boosted trees, in SQL functions only.

Four rules give the base spans, which always stay. Generators of high recall propose
further, overlapping candidates. Gradient boosted trees score each candidate from its
format (length, digits, separators, groups, checks) and context (neighbouring
characters); they are trained on the candidates of all documents, where a
candidate is positive if it is a base span of its kind. The trees become column
expressions, so scoring stays in the plan of the scan. A threshold for each kind is
calibrated on a third of the candidates that the trees don't see: the lowest score from
which at least `precision` of the candidates are positive. Candidates above it that
overlap no base span, nor a better candidate, are added.

Defined cases: null and empty texts have no spans; texts are read whole; repeated rows
give repeated rows; without enough examples of both classes nothing is added.
Positions count code points; ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_text, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, DEPTH = 8, 3
PRECISION = 0.98

# What the rules match; a lookbehind starts a match only where a run begins or the
# last match ended, and possessive runs never go back: the same matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9]([\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

WIDE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]{1,63}){0,8}",
    "ip": r"[0-9]{1,4}(?:[.,:-][0-9]{1,4}){3,7}",
    "card": r"[0-9](?:[\x20.-]?[0-9]){11,22}",
    "phone": r"[+(]?[0-9][0-9\x20().-]{6,20}[0-9]",
}
ANY_HINT = r"@|\[at\]|\(at\)|[0-9][0-9\x20().,:-]{6}"

FEATURES = ("kind", "size", "digits", "letters", "seps", "dots", "groups", "longest", "plus", "at", "luhn",
            "octets", "left_word", "right_word", "left_mark", "right_mark")


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of a pattern's matches, from the gaps between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.struct(hits.alias("hits"), gaps.alias("gaps"))

    def place(p: Column) -> Column:
        def one(i: Column) -> Column:
            start = F.aggregate(F.slice(p["gaps"], F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)) + F.when(
                i > 1, F.aggregate(F.slice(p["hits"], F.lit(1), i - 1), F.lit(0), lambda a, h: a + F.length(h))
            ).otherwise(0)
            hit = F.get(p["hits"], i - 1)
            return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

        return F.transform(F.sequence(F.lit(1), F.size(p["hits"])), one)

    placed = F.flatten(F.transform(F.array(both), lambda p: F.when(F.size(p["hits"]) > 0, place(p)).otherwise(none())))
    return placed


def none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,hit:string>>")


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits of a hit pass the check of card numbers."""
    d = F.reverse(digits_of(hit))
    at = F.sequence(F.lit(1), F.length(d))

    def share(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(at, F.lit(0), lambda a, i: a + share(i))
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(F.lit(False))


def octets(hit: Column) -> Column:
    """Whether a hit is four dotted numbers of at most 255."""
    parts = F.split(hit, "\\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    fits = F.forall(parts, lambda p: F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")), F.lit(999)) <= 255)
    return (F.size(parts) == 4) & small & fits


def valid(kind: str, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: octets(hit),
        "card": lambda: n.between(16, 19) & luhn(hit),
        "phone": lambda: n.between(8, 15),
    }[kind]()


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, BASE[kind]), lambda h: valid(kind, h["hit"]))
    return F.when(text.rlike(HINT[kind]), found).otherwise(none())


def candidates(text: Column, kind: str) -> Column:
    """Wide candidates of a kind with their features."""
    number = KINDS.index(kind)

    def described(h: Column) -> Column:
        hit = h["hit"]
        left = F.when(h["start"] > 0, F.substring(text, h["start"], F.lit(1))).otherwise("")
        right = F.substring(text, h["end"] + 1, F.lit(1))
        runs = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
        flag = lambda c: c.cast("double")
        size = lambda c: F.length(c).cast("double")
        values = {
            "kind": F.lit(float(number)), "size": size(hit), "digits": size(digits_of(hit)),
            "letters": size(F.regexp_replace(hit, "[^A-Za-z]", "")), "seps": size(F.regexp_replace(hit, "[A-Za-z0-9]", "")),
            "dots": size(F.regexp_replace(hit, "[^.]", "")), "groups": F.size(runs).cast("double"),
            "longest": F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0)).cast("double"),
            "plus": flag(hit.startswith("+")), "at": flag(hit.contains("@")), "luhn": flag(luhn(hit)), "octets": flag(octets(hit)),
            "left_word": flag(left.rlike("[\\p{L}\\p{N}]")), "right_word": flag(right.rlike("[\\p{L}\\p{N}]")),
            "left_mark": flag(left.rlike("[\"'=_.+@-]")), "right_mark": flag(right.rlike("[\"'=_@-]")),
        }
        return F.struct(F.lit(kind).alias("name"), h["start"].alias("start"), h["end"].alias("end"),
                        *[values[f].alias(f) for f in FEATURES])

    return F.transform(located(text, WIDE[kind]), described)


def all_candidates(text: Column) -> Column:
    every = F.concat(*[candidates(text, k) for k in KINDS])
    empty = "array<struct<name:string,start:int,end:int," + ",".join(f"{f}:double" for f in FEATURES) + ">>"
    return F.when(text.rlike(ANY_HINT), every).otherwise(F.array().cast(empty))


def step(column: Column) -> Column:
    """An expression made once per row, however often what follows refers to it."""
    return F.explode(F.array(column))


def with_base(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_base", step(F.struct(*[base_spans(F.col(text), k).alias(k) for k in KINDS])))


# --- the trees -------------------------------------------------------------------


def tree_score(node, feature: dict[int, Column]) -> Column:
    """A fitted regression tree as an expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        feature[split.featureIndex()] <= float(split.threshold()), tree_score(node.leftChild(), feature)
    ).otherwise(tree_score(node.rightChild(), feature))


class Judge:
    """Fitted trees and the threshold of each kind; no trees: nothing is added."""

    def __init__(self, model, thresholds: dict[str, float]):
        self.model, self.thresholds = model, thresholds

    def score(self, c: Column) -> Column:
        if self.model is None:
            return F.lit(0.0)
        feature = {i: c[f] for i, f in enumerate(FEATURES)}
        parts = [
            F.lit(float(w)) * tree_score(t._java_obj.rootNode(), feature)
            for w, t in zip(self.model.treeWeights, self.model.trees)
        ]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, parts)))

    def accepts(self, c: Column, score: Column) -> Column:
        return reduce(lambda a, k: F.when(c["name"] == k, score >= F.lit(self.thresholds[k])).otherwise(a), KINDS, F.lit(False))


def examples(docs: DataFrame, text: str) -> DataFrame:
    """One row per candidate of the documents: its features and whether a rule has it."""
    rows = with_base(docs.select(whole_text(text).alias("body")), "body")
    rows = rows.select("_base", F.explode(all_candidates(F.col("body"))).alias("c"))
    same = reduce(
        lambda a, k: F.when(F.col("c.name") == k, F.exists(
            F.col("_base")[k], lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end"))
        )).otherwise(a), KINDS, F.lit(False))
    return rows.select("c.*", same.cast("double").alias("label"))


def train(df: DataFrame, text: str = "text", precision: float = PRECISION) -> Judge:
    """Trees and thresholds from the candidates of all documents.

    Equal candidates are one row with a weight, so the table the trees read grows with
    the number of formats and contexts, not with the number of documents.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = examples(df, text).withColumn("part", F.pmod(F.xxhash64("name", "start", "end", *FEATURES[1:4]), F.lit(3)))
    rows = written(rows.groupBy("name", *FEATURES, "label", "part").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    learnt = rows.where("part > 0")
    counts = dict(learnt.groupBy("label").agg(F.sum("weight")).collect())
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 10:
        return Judge(None, dict.fromkeys(KINDS, 2.0))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    tool = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=1, featuresCol="features", labelCol="label", weightCol="weight")
    judge = Judge(tool.fit(vector.transform(learnt)), {})
    c = F.struct("name", *FEATURES)
    judged = rows.where("part = 0").select("name", "label", "weight", F.floor(judge.score(c) * 50).cast("int").alias("bin"))
    table = judged.groupBy("name", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()
    for kind in KINDS:
        total = good = 0.0
        judge.thresholds[kind] = 2.0
        for r in sorted((r for r in table if r["name"] == kind), key=lambda r: -r["bin"]):
            total, good = total + r["n"], good + r["good"]
            if total >= 10 and good / total >= precision:
                judge.thresholds[kind] = max(0.5, r["bin"] / 50)
    return judge


# --- spans, redaction --------------------------------------------------------------


def spans(df: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """df with `base` and `found`: for each kind the (start, end) of rule and all spans."""
    if {"base", "found", "_body", "_base", "_added"} & set(df.columns):
        raise ValueError("columns base, found, _body, _base or _added exist already")
    rows = with_base(df.withColumn("_body", whole_text(text)), "_body")
    rule = F.flatten(F.array(*[F.col("_base")[k] for k in KINDS]))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    if judge.model is None:
        added = F.array().cast("array<struct<name:string,start:int,end:int,score:double>>")
    else:
        scored = F.transform(all_candidates(F.col("_body")), lambda c: F.struct(
            c["name"].alias("name"), c["start"].alias("start"), c["end"].alias("end"), judge.score(c).alias("score")))
        added = F.filter(scored, lambda c: judge.accepts(c, c["score"]) & ~F.exists(rule, lambda b: meets(b, c)))
    rows = rows.withColumn("_added", step(added))
    rank = lambda c: F.struct(c["score"], c["end"] - c["start"], -c["start"], c["name"])
    best = F.filter(F.col("_added"), lambda c: ~F.exists(F.col("_added"), lambda o: meets(o, c) & (rank(o) > rank(c))))
    plain = lambda a: F.transform(a, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    of = lambda k: F.filter(best, lambda c: c["name"] == k)
    base = F.struct(*[plain(F.col("_base")[k]).alias(k) for k in KINDS])
    every = F.struct(*[F.sort_array(F.concat(plain(F.col("_base")[k]), plain(of(k)))).alias(k) for k in KINDS])
    rows = rows.withColumns({"base": base, "found": step(every)})
    return rows.drop("_base", "_added", "_body")


def span_text(found: Column) -> Column:
    """kind:start:end of all spans by kind as listed, then start, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(found[kind], lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(of, KINDS)), ",")


def redacted(df: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """df with every span of its text replaced by the kind in brackets, [EMAIL] say.

    Of overlapping spans the first begins the replacement, and what it covers goes.
    """
    rows = spans(df, judge, text)

    def tagged(kind: str) -> Column:
        return F.transform(F.col("found")[kind], lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.upper()).alias("tag")))

    flat = F.array_sort(F.concat(*map(tagged, KINDS)))
    body = whole_text(text)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["at"], F.substring(body, a["at"] + 1, s["start"] - a["at"])).otherwise("")
        tag = F.when(s["start"] >= a["at"], F.concat(F.lit("["), s["tag"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], gap, tag).alias("out"))

    built = F.aggregate(flat, state, add, lambda a: F.concat(a["out"], F.substring(body, a["at"] + 1, F.length(body))))
    some = reduce(lambda a, b: a | b, [F.size(F.col("found")[k]) > 0 for k in KINDS])
    return rows.withColumn(text, F.when(some, built).otherwise(F.col(text))).select(*df.columns)


def span_digests(df: DataFrame, judge: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = spans(df.select(key, text), judge, text)
    counts = [F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(key, *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       span_text(F.col("found")).alias("spans"))
