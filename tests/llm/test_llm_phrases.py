import re
from collections import Counter

from conftest import SMALL
from corpus import LOWER, awkward
from pyspark.sql import functions as F

from lodeworks.llm import phrases
from lodeworks.llm.phrases import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_force(rows, longest=4, fewest=30, top=2000):
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            own.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= fewest}
        top_inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    top_inside[p[i:i + k]] = max(top_inside[p[i:i + k]], a)
        rows = []
        for p, a in often.items():
            score, _, x, y = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            if 100 * top_inside[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(rows)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, x, y, totals[lang], -score))
    return sorted(out)


def result(docs, *more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, *more).collect())


def test_phrases_equal_brute_force_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    wanted = brute_force(rows)
    assert result(docs) == wanted and len(wanted) > 20
    assert result(docs, 3, 5, 40) == brute_force(rows, 3, 5, 40)


def test_phrases_of_awkward_texts(spark):
    docs = awkward(spark).withColumn("phrase", F.lit("clash")).withColumn("block", F.lit(1))
    more = [(None, "Of THE. of the, of the;of the:of the!of the?of the\nof the\x0bof the\rof the\x0cof\tthe  of the " * 3),
            ("und", "of the " * 40), ("", "x y " * 31 + "\x85 \x1c"), ("de", "a a a a a " * 30)]
    rows = docs.select("lang", "text").unionByName(spark.createDataFrame(more, "lang string, text string"))
    wanted = brute_force([tuple(r) for r in rows.collect()])
    assert result(rows) == wanted and {r[0] for r in wanted} == {"en", "und", "", "de", "fr"}
    assert result(docs) == brute_force([(r["lang"], r["text"]) for r in docs.collect()])
    assert result(rows.limit(0)) == [] == result(rows.where("text is null"))
    assert collocations(rows).columns == COLUMNS


def test_scores_pass_64_bits(spark):
    most = (1 << 62) - 1
    row = spark.range(1).select(F.lit(most).alias("f"))
    got = row.select(F.expr("cast(2000000 as decimal(7)) * cast(f as decimal(19)) div cast(f + f as decimal(20))")).first()[0]
    assert got == 1_000_000


def test_phrases_are_numbered_apart_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROWS_PER_BUCKET", 50)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).repartition(5)
    tables, _ = phrases.frequent_phrases(docs, 3, 4)
    for t in tables:
        rows = t.collect()
        assert len({r["number"] for r in rows}) == len(rows) == len({(r["lang"], r["phrase"]) for r in rows}) > 20
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert result(docs, 3, 4, 50) == brute_force(rows, 3, 4, 50)


def test_blocks_keep_pieces_and_languages_apart():
    import pyarrow as pa

    made = phrases._word_block(pa.array(["A b. c", None, "b"]), "en", 7)
    words, codes = made["words"][0].as_py(), made["codes"][0].as_py()
    assert [words[c] if c >= 0 else None for c in codes] == ["a", "b", None, "c", None, "b"]
    assert phrases._word_block(pa.array([" .,", ""]), "en", 7) is None


def test_workers_are_given_one_block_at_a_time(spark):
    blocks = spark.createDataFrame(
        [(b, [0, 1, -1, 0, 1, 2]) for b in range(6)], "block long, codes array<int>").coalesce(1)
    kept = spark.createDataFrame(
        [(b, code, 7 + code) for b in range(5) for code in range(b and 2)], "block long, code int, number long")
    longer = phrases._extend(blocks, kept, 6)
    # neither the numbers of a block in one row nor several blocks in one batch
    plan = longer._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "collect_list" not in plan
    found = {r["block"]: (r["codes"], r["pairs"], r["counts"]) for r in longer.collect()}
    assert found == {b: ([0, -1, -1, 0, -1, -1], [7 << 32 | 8], [2]) for b in range(1, 5)}
