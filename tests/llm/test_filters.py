"""Personal data, toxicity, languages, preference pairs and the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixelframe.llm import language, pii, preference, queries, toxicity
from pixelframe.llm.common import with_next

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "plain words only", "a.b+c@d-e.co.uk, x@y and p@q.r", "a@b.c+d@e.f", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "é +1 (555) 555-0199. +49 30 1234567 +1 2", "@@ a@@b.c @x.y", "..%@a.b" * 30,
    "call +12345678901234567890 now", "🎉 mail me🎉@x.io or m@x.io 🎉", "9" * 200, "192.168.0.1" * 5, "a" * 5000 + "@" + "b.c",
]


def fits(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def rule_spans(text):
    return [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_rules(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "m@x.io", 2)], "doc_id long, text string, spans int")
    judge = pii.Judge(None, {})
    rows = {r.doc_id: r for r in pii.span_digests(df.select("doc_id", "text"), judge).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        want = rule_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = rows[i]
        assert r.spans == text
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == w[0] for w in want) for k in RULES]
    assert pii.span_digests(df.select("doc_id", "text").limit(0), judge).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cd und +1 (555) 555-0199!", "k"), (2, None, "k"), (3, "nichts", "k")], "doc_id long, text string, base string")
    rows = {r.doc_id: r.text for r in pii.redacted(df.select("doc_id", "text"), pii.Judge(None, {})).collect()}
    assert rows == {1: "é [EMAIL] und [PHONE]!", 2: None, 3: "nichts"}


def test_trained_spans_keep_the_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(1)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = [(10_000 + i, f"{number(3)} a{i}@mail.example.com, {number(16)} or +1 ({number(3)}) 555-{number(4)} id 10.0.{i}.7 v{number(2)}.{number(9)}")
            for i in range(80)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    judge = pii.train(both)
    assert judge.model is not None
    texts = {r.doc_id: r.text for r in both.collect()}
    for r in pii.span_digests(both, judge).collect():
        want = rule_spans(texts[r.doc_id])
        found = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(want) <= set(found)
        assert found == sorted(found, key=lambda s: (list(RULES).index(s[0]), s[1]))
        for k, a, b in set(found) - set(want):
            assert not any(a < e and s < b for _, s, e in want)


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["grumblefig", "snarkwort", "vexwhistle"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        body = [rng.choice(bad) if toxic and rng.random() < 0.12 else rng.choice(words) for _ in range(60)]
        rows.append((i, " ".join(body), "x", 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None, "x", 0.1), (None, "", None, None), rows[0]], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 603
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.learn(docs, known.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), none).collect()} == {0.0}


def test_toxicity_learns_only_from_its_rows(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs, flipped)
    assert (a.weights == b.weights).all() and a.toxic == b.toxic


def test_language(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(50_001, None, "en"), (50_002, "123 !?", "en"), (50_003, "", None), (None, "the of and", None)], docs.schema)
    model = language.learn(docs.union(extra))
    got = language.predict(docs.union(extra), model, keep=("doc_id", "lang")).collect()
    odd = [r for r in got if (r.doc_id or 0) > 50_000]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in odd)
    held = [r for r in got if r.lang and r.lang_pred != "und" and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {language.FAMILY_OF[n] for n in ("en", "de")} == {"germanic"} and ("de", "en") in model.fine
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs.limit(5), language.learn(docs.limit(0))).collect()} == {"und"}


def test_language_of_many_copies_is_learnt(spark, monkeypatch):
    names = [x + y for x in "abcdefghij" for y in "klmnopqrst"]
    rows = [(i, "det samme igen og igen", "da") for i in range(6000)]
    rows += [(30_000 + i, f"en anden tekst {n}", "da") for i, n in enumerate(names)]
    monkeypatch.setattr(language, "fit", lambda texts, langs: (texts, langs))
    texts, langs = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert langs == ["da"] * 10 and len(set(texts)) == 10


def test_preferences(spark):
    turns = "pair_id long, turn int, role string, text string, prompt string"
    chosen = [(1, 0, "system", "s", ""), (1, 1, "user", "hi", ""), (1, 2, "assistant", "good", ""), (1, 3, "user", None, ""), (2, 0, None, "x", ""),
              (3, 0, "user", "only", ""), (3, 0, "user", "only", ""), (None, 0, "user", "n", "")]
    rejected = [(1, 0, "system", "s", ""), (1, 1, "user", "hi", ""), (1, 2, "assistant", "bad!", ""), (2, 0, "user", "y", ""), (3, 0, "user", "only", ""),
                (None, 0, "user", "n", "")]
    rows = {r.pair_id: r for r in preference.preferences(*(spark.createDataFrame(t, turns) for t in (chosen, rejected))).collect()}
    one = rows[1]
    assert one.prompt == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 2
    assert one.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\n<|end|>\n"
    assert one.rejected == "<|assistant|>\nbad!<|end|>\n"
    start, end = map(int, one.chosen_mask.split(":"))
    assert one.chosen[start:end] == "good<|end|>"
    start, end = map(int, one.rejected_mask.split(":"))
    assert one.rejected[start:end] == "bad!<|end|>"
    assert rows[2].prompt == "" and rows[2].chosen_mask == "" and rows[2].rejected == "<|user|>\ny<|end|>\n"
    assert rows[3].n_prompt_turns == 1 and rows[3].chosen == rows[3].rejected == ""
    assert rows[None].n_prompt_turns == 1


def test_long_conversations_are_cut_in_segments(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(200)]
    other = turns[:150] + [(1, 150, "user", "else")]
    rows = preference.preferences(*(spark.createDataFrame(t, "pair_id long, turn int, role string, text string") for t in (turns, other))).collect()
    rows.sort(key=lambda r: r.segment)
    assert [r.n_prompt_turns for r in rows] == [64, 64, 22, 0]
    assert "".join(r.chosen for r in rows).count("<|end|>") == 50 and "".join(r.rejected for r in rows) == "<|user|>\nelse<|end|>\n"


def test_next_row(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    for keys in ([], [4], [None, 2, 2], rng.sample(range(100_000), 700), list(range(300)) * 2):
        df = spark.createDataFrame([(k, f"{i}") for i, k in enumerate(keys)], "k long, v string")
        got = with_next(df, "k", F.col("v"), ["v"]).collect()
        order = sorted(((k if k is not None else -1, f"{i}") for i, k in enumerate(keys)))
        want = {v: order[(i + 1) % len(order)][1] for i, (_, v) in enumerate(order)}
        assert {r.v: r.next_v for r in got} == want and len(got) == len(keys)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, names = docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        names.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept = docs
    assert names[0][1] <= before and names[1][1] <= names[0][1] == names[0][1]
    assert names[1][1] == names[2][1] == names[3][1] == docs.select("doc_id").distinct().count()
    assert all(not rule_spans(r.text) for r in kept.select("text").collect())
    run = corpus_pipeline.run(spark, folder)
    assert sorted(run.collect()) == sorted(docs.collect())


def test_registered():
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in queries.QUERIES)] == []


@pytest.mark.parametrize("text, letter", [("²", False), ("½ ¾", False), ("Ⅷ", False), ("12_3", False), ("", False), ("́", False), ("Ⅷ a", True), ("ß", True), ("½" * 100_000 + "é", True)])
def test_numerals_are_no_letters(text, letter):
    assert language.has_letter(text) is letter


def test_trees_learn_from_all_documents(spark, monkeypatch):
    """Candidates of the last of many documents count, each with its weight."""
    seen = []
    keep = pii.written
    monkeypatch.setattr(pii, "written", lambda df: seen.append(keep(df)) or seen[-1])
    plain = spark.range(9000).selectExpr("id as doc_id", "concat('no number here ', id % 7) as text")
    tail = spark.range(9000, 9040).selectExpr("id as doc_id", "'mail ann@example.org or call 123 456 789 1' as text")
    pii.train(plain.unionByName(tail).coalesce(1))
    assert {r["name"]: r["n"] for r in seen[0].groupBy("name").agg(F.sum("weight").alias("n")).collect()} == {"email": 40, "phone": 40}
