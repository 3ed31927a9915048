import gzip
import io
import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from corpus import awkward
from pyspark.sql import functions as F

from lodeworks.llm import warc
from lodeworks.llm.components import components
from lodeworks.llm.decontam import item_windows, leaks, without_leaks
from lodeworks.llm.langid import host_parts, identify, read_page, train, visible_text
from lodeworks.llm.secret_scan import mask_secrets, scan
from lodeworks.llm.sharding import fill_table, place, slot_of
from lodeworks.llm.toxicity import PENALTIES, Terms, fit_ordinal, grade_documents
from lodeworks.llm.toxicity import _tuned as tuned
from lodeworks.llm.toxicity import train as train_toxicity


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


# components

def test_components_of_a_long_path_a_star_and_a_clique(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(50)]
    clique = [(a, b) for a in range(2000, 2008) for b in range(2000, 2008)]
    links = spark.createDataFrame(path + star + clique + [(5, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{1000 + i: 7 for i in range(50)},
                   **{i: 2000 for i in range(2000, 2008)}}


# decontamination

QUESTIONS = [
    (1, "If John Smith has 5 apples and gives 3 apples to Mary Jones then how many kg of them remain in 12 kg."),
    (2, "If Paul has 7 apples and gives 4 apples to Ann then how many kg of them remain in 99 lb."),
    (3, "If Paul has 7 apples and gives 7 apples to Ann then how many kg of them remain in 99 lb."),
    (4, "Other words entirely stand here and none of the sentence above is ever said again by anyone."),
    (5, None), (6, ""), (7, "if 5 apples"), (None, "nothing of note is to be found in this text at all"),
]


def test_reparameterised_questions_are_found_and_inconsistent_ones_are_not(spark):
    docs = spark.createDataFrame(QUESTIONS, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, QUESTIONS[0][1]), (11, None), (12, "too short"), (None, "x y z w v u t s")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in leaks(docs, items).collect()}
    assert got == {(1, 10): True, (2, 10): False}
    left = {r["doc_id"] for r in without_leaks(docs, items).collect()}
    assert left == {3, 4, 5, 6, 7, None}
    assert without_leaks(docs, items).columns == docs.columns


def test_every_copied_item_is_found_and_nothing_else(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    texts, wanted = docs.collect(), items.collect()
    copied = {(d["doc_id"], b["item_id"]) for d in texts for b in wanted if b["text"] in d["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()} == copied and copied
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0


def test_a_benchmark_beyond_the_broadcast_bound_is_searched_in_blocks(spark, monkeypatch):
    from lodeworks.llm import decontam

    docs, items = table(spark, "documents"), table(spark, "benchmark")
    whole = {tuple(r) for r in leaks(docs, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", item_windows(items).count() // 3)
    assert {tuple(r) for r in leaks(docs, items).collect()} == whole


def test_items_of_any_words_case_and_length_are_found(spark):
    items = [
        (1, "What is 12 + 7 x 3 - 4 / 2?"), (2, "Who Wrote The Old Blue Book"), (3, "NAME THE RED PLANET NOW"),
        (4, "Which river runs through the old town?"), (5, "Boil eggs"), (6, "Is 1.5 more?"),
        (7, "Tom has 5 red pens"), (8, "?!"),
    ]
    docs = [
        (1, "they asked what is 12 + 7 x 3 - 4 / 2? once"), (11, "now: What is 15 + 8 x 6 - 9 / 3?"),
        (2, "he read: Who Wrote The Old Blue Book today"), (3, "go on and NAME THE RED PLANET NOW"),
        (4, "She asked Which river runs through the old town? twice"), (5, "we boil eggs"),
        (6, "is 1.5 more than that"), (16, "is 105 more than that"), (7, "so Ann has 9 red pens"), (8, "?!"),
    ]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["exact"] for r in got} == {
        (1, 1): True, (11, 1): False, (2, 2): True, (3, 3): True, (4, 4): True, (5, 5): True, (6, 6): True,
        (7, 7): False}


# sharding

def test_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    full = fill_table(names, 10007)
    assert Counter(Counter(full.tolist()).values()).keys() <= {500, 501}
    less = fill_table(names[:-1], 10007)
    moved = (np.array(names)[full] != np.array(names)[less]) & (full != 19)
    assert moved.mean() < 0.05
    mixed = fill_table(names[::-1], 10007)
    assert (np.array(names)[full] == np.array(names[::-1])[mixed]).all()
    heavy = Counter(fill_table(["a", "b"], 1009, [3, 1]).tolist())
    assert abs(heavy[0] - 3 * heavy[1]) <= 4
    for bad in (dict(shards=[]), dict(shards=["a", "a"]), dict(shards=["a"], slots=10)):
        with pytest.raises(ValueError):
            fill_table(**bad)


def test_placement_is_a_look_up_without_a_shuffle(spark):
    docs = awkward(spark).withColumn("shard", F.lit("old"))
    names = [f"s{i}" for i in range(5)]
    placed = place(docs, ["doc_id", "source"], names, slots=101)
    owners = fill_table(names, 101).tolist()
    slots = docs.select(slot_of("doc_id", "source", slots=101).alias("slot")).collect()
    assert Counter(r["shard"] for r in placed.collect()) == Counter(names[owners[r["slot"]]] for r in slots)
    assert "hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    assert place(docs.limit(0), ["doc_id"], names, slots=101).count() == 0


# WARC

def test_archives_hold_whole_records_and_are_read_by_few_ranges(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", None),
        (4, None, ""), (5, "http://a/5\r\nX: y", "é" * 1000), (6, "u", "<p>same</p>"), (6, "u", "<p>same</p>"),
        (None, "n", "<p>same</p>"), (8, "v", "x\r\n\r\nWARC/1.1\r\n" * 50), (9, "w", "y" * 300_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    index = warc.write_archives(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    html = {(i, h or "") for i, _, h in rows}
    for r in got:
        own = [h for i, h in html if i == r["page_id"]]
        assert len(own[0].encode()) == r["payload_bytes"] and warc.payload_digest(own[0].encode()) == r["payload_digest"]
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == own[0].encode()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[1, "revisit", 6] == kinds[2, "revisit", 6] == kinds[3, "revisit", 4] == 1
    assert kinds[6, "response", None] == kinds[6, "revisit", 6] == kinds[None, "response", None] == 1
    places = index.orderBy("path", "offset").collect()
    for path in {r["path"] for r in places}:
        own = [r for r in places if r["path"] == path]
        local = re.sub("^file:(//)?", "", path)
        assert own[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:]))
        assert own[-1]["offset"] + own[-1]["length"] == os.path.getsize(local)
        plain = gzip.open(local).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long"), (4, "d", "long")],
                                  "page_id long, url string, html string")
    got = warc.read_records(warc.write_archives(pages, min_revisit_bytes=3)).collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {
        1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_ranges_are_joined():
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 300, 5), ("b", 0, 1)]
    assert list(warc.coalesced(ranges, read_bytes=100, gap_bytes=30)) == [
        ("a", 0, 45, [0, 1, 2]), ("a", 300, 305, [3]), ("b", 0, 1, [4])]
    assert [r[3] for r in warc.coalesced(ranges, read_bytes=12, gap_bytes=30)] == [[0], [1], [2], [3], [4]]


def test_a_broken_record_is_refused():
    raw = warc.record_bytes(1, "u", b"abc", warc.payload_digest(b"abd"))
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb") as out:
        out.write(raw)
    with pytest.raises(ValueError):
        warc._row(packed.getvalue(), True)


# language

def test_languages_of_pages(spark):
    model = train(table(spark, "documents"))
    pages = table(spark, "pages").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in identify(pages, model).collect()}
    truth = {r["page_id"]: r["url"].split("/")[3] for r in pages.collect()}
    assert np.mean([got[i]["lang"] == lang for i, lang in truth.items()]) >= 0.98
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", ""), (3, "http://x.de/", "<html lang=de>"), (3, "http://x.de/", "<html lang=de>"),
         (None, "//u@h:8/", "<p" * 50)], "page_id long, url string, html string")
    rows = identify(odd, model).collect()
    assert len(rows) == 5 and all(r["lang"] in model.languages for r in rows)
    assert identify(odd.limit(0), model).count() == 0
    empty = train(table(spark, "documents").limit(0))
    assert identify(odd, empty).where("lang is null").count() == 5


def test_declaration_and_host_decide_where_text_is_silent(spark):
    model = train(table(spark, "documents"))
    pages = table(spark, "pages").select("page_id", "url", "html")
    silent = spark.createDataFrame(
        [(-1, "http://quiet.example.com/", '<html lang="fr"></html>')], pages.schema)
    assert identify(pages.union(silent), model).where("page_id = -1").first()["lang"] == "fr"


def test_page_parts():
    assert host_parts("https://u:p@News.Example.CO.uk:80/x?y#z") == ("news.example.co.uk", "co.uk", "uk")
    assert host_parts(None) == host_parts("no address") == ("", "", "")
    assert read_page("<!-- " + "x" * 9000 + "--><HTML lang='fr'>a") == ("  a", "fr")
    assert read_page('<!-- <html lang="de"> --><script><html lang="es"></script><html lang="fr">')[1] == "fr"
    assert read_page('<html><html id=x lang=pt-BR>a < b <unended')[1:] == ("pt",)
    for part in ("<script ", "<!-- ", "<", "<html ", "</script ", "<style>"):
        started = time.monotonic()
        read_page(part * (2_000_000 // len(part)))
        assert time.monotonic() - started < 5, part
    assert visible_text("<script>a<b</script>x<!-- > -->&amp;<style>p</style>y").split() == ["x", "&", "y"]


# secrets

def test_secrets_are_told_from_other_long_runs(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    planted = {
        (i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    got = scan(docs).collect()
    assert {(r["doc_id"], r["start"]) for r in got if r["secret"]} == planted and planted
    assert any(not r["secret"] for r in got)
    masked = {r["doc_id"]: r["text"] for r in mask_secrets(docs).collect()}
    assert masked == {i: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1<SECRET>"', t) for i, t in texts.items()}


def test_given_labels_train_the_forest(spark):
    docs = table(spark, "documents")
    found = scan(docs)
    turned = found.select("doc_id", "start", (~F.col("secret")).cast("int").alias("label"))
    agree = scan(docs, turned).join(turned, ["doc_id", "start"]).where(F.col("secret") == (F.col("label") == 1))
    assert agree.count() >= 0.95 * turned.count()
    one_kind = turned.withColumn("label", F.lit(1))
    assert scan(docs, one_kind).where("not secret").count() == 0


def test_secrets_of_awkward_rows(spark):
    data = awkward(spark)
    kept = mask_secrets(data)
    assert kept.columns == data.columns and kept.count() == data.count()
    assert scan(data.limit(0)).count() == 0 and mask_secrets(data.limit(0)).count() == 0


# toxicity

def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000)
    grades = np.digitize(2 * x + rng.logistic(size=3000), [0.5, 2.5])
    w, theta = fit_ordinal(np.arange(3000), np.zeros(3000, int), x, grades, 1, penalty=0)
    assert abs(w[0] - 2) < 0.3 and abs(theta[0] - 0.5) < 0.3 and abs(theta[1] - 2.5) < 0.4


def test_toxic_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = train_toxicity(docs, labels.where(half))
    rows = grade_documents(docs, model).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    caught = [r["toxic"] for r in rows if r["y"] == 1]
    wrong = [r["toxic"] for r in rows if r["y"] == 0]
    assert np.mean(caught) >= 0.6 and np.mean(wrong) <= 0.02
    assert all(r["kept"] != r["toxic"] and 0 <= r["expected_severity"] <= 2 for r in rows)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = train_toxicity(awkward(spark), labels)
    assert grade_documents(awkward(spark), model).count() == awkward(spark).count()
    none = train_toxicity(awkward(spark), labels.limit(0))
    assert grade_documents(awkward(spark), none).where("toxic").count() == 0
    graded = labels.where("toxic is not null").withColumn("severity", F.col("toxic") * 3)
    assert len(train_toxicity(awkward(spark), graded).thresholds) in (1, 3)


def test_limits_are_chosen_on_rows_left_out():
    rng = np.random.default_rng(6)
    n, held = 600, 12
    toxic = np.arange(n) % 10 == 0
    buckets = np.where(np.repeat(toxic, held)[:, None], rng.integers(0, 40, (n * held, 1)), rng.integers(30, 400, (n * held, 1)))
    terms = Terms(np.repeat(np.arange(n), held), buckets.ravel(), np.ones(n * held), np.full(n, held),
                  toxic.astype(np.int64) * 2, True)
    penalty, limit = tuned(terms)
    assert penalty in PENALTIES and 0.5 <= limit <= 0.95
    assert tuned(terms._replace(grades=np.where(np.arange(n) == 0, 2, 0))) == (PENALTIES[0], 0.5)


# pipeline

def test_pipeline_stages_tell_rows_without_or_with_equal_ids_apart(spark):
    import corpus_pipeline as pipeline

    words = [f"w{i}" for i in range(100)]
    near = [*words[:90], *[f"z{i}" for i in range(10)]]  # 86 of 106 shingles shared
    token = 'token = "' + "0f1e2d3c4b" * 4 + '"'
    texts = [(None, " ".join(words)), (None, " ".join(words)), (5, " ".join(near)), (5, "other " + " ".join(words[::-1])),
             (5, "other " + " ".join(words[::-1])), (6, None), (None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("_own", F.lit(1))
    left = pipeline.near_duplicate_groups(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert sorted(len(r["text"] or "") for r in left.collect()) == [0, 0, len(" ".join(words)), len(texts[3][1])]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    leaky = spark.createDataFrame(
        [(None, f"so {item} it is"), (None, "clean words only"), (7, f"so {item} it is"), (7, "clean too")],
        "doc_id long, text string")
    kept = pipeline.benchmark_leaks(spark, leaky, SMALL).collect()
    assert sorted(r["text"] for r in kept) == ["clean too", "clean words only"]
    hidden = spark.createDataFrame([(None, f"a {token}"), (8, f"bb {token}"), (8, "plain"), (8, None)],
                                   "doc_id long, text string")
    got = pipeline.secrets(spark, hidden, SMALL).collect()
    assert sorted(str(r["text"]) for r in got) == ["None", 'a token = "<SECRET>"', 'bb token = "<SECRET>"', "plain"]

def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    documents = table(spark, "documents")
    docs = documents.unionByName(awkward(spark).select(documents.columns))
    counts = [docs.count()]
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL)
        if name != "tokens":
            assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 50
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert pipeline.run(spark, SMALL).where("size(ids) <> n_tokens").count() == 0
