import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from corpus import awkward, base_counts, cut_repeats, near_components, words
from tokenizers import Tokenizer

from lodeworks.llm import bpe
from lodeworks.llm import words as scanner
from lodeworks.llm.bpe import Codec, _parts, decode_documents, encode_documents, read_vocabulary, token_digests
from lodeworks.llm.neardup import near_duplicates, signatures
from lodeworks.llm.quality import js_distance, keep_good, quality_report, references
from lodeworks.llm.substrings import remove_repeats

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_words_at_any_block_size(monkeypatch, block):
    monkeypatch.setattr(scanner, "_BLOCK", block)
    texts = ["ab cd", None, "", " x ", "longword" * 9 + " y", "cd", "été ab\x0b", "z"]
    found = scanner.words(pa.array(texts))
    expected = [words(t) for t in texts]
    assert np.diff(found.first).tolist() == [len(w) for w in expected]
    seen = {}
    for word, value in zip((w for ws in expected for w in ws), found.hashes.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    folded = scanner.words(pa.array(["AbC É", "aBc é"]), fold=True).hashes
    assert folded[0] == folded[2] and folded[1] != folded[3]


def test_grams_tell_windows_apart():
    values = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2], np.uint64)
    for size in range(1, 9):
        seen = {}
        for i, gram in enumerate(scanner.grams(values, size).tolist()):
            assert seen.setdefault(tuple(values[i:i + size].tolist()), gram) == gram
        assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows(monkeypatch):
    monkeypatch.setattr(scanner, "SLICE_BYTES", 10)
    batch = pa.record_batch({"text": ["a" * 30, "b", None, "c" * 9, "d"], "i": [0, 1, 2, 3, 4]})
    parts = list(scanner.slices([batch, batch.slice(0, 0)], "text"))
    assert [i for p in parts for i in p.column(1).to_pylist()] == [0, 1, 2, 3, 4] and len(parts) > 2


def test_quality_counts_and_verdicts(spark):
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    data = real.unionByName(awkward(spark).drop("words", "mark"))
    texts = sorted((r["text"] or "", r["doc_id"]) for r in data.collect() if r["doc_id"] is not None)
    report = quality_report(data).collect()
    assert len(report) == data.count()
    got = sorted(
        (r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        for r in report if r["doc_id"] is not None)
    assert got == sorted((i, *base_counts(t)) for t, i in texts)
    for r in report:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    # the added rows share ids with labelled documents, so they are judged apart
    own = quality_report(real, references(data)).collect()
    sure = [(labels[r["doc_id"]], r["kept"]) for r in own if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for q, k in sure if q == 1) == sum(q == 1 for q, _ in sure)


def test_quality_of_an_empty_table_and_extra_columns(spark):
    empty = awkward(spark).limit(0)
    assert references(empty) == {} and quality_report(empty).count() == 0
    kept = keep_good(awkward(spark), min_words=100)
    assert kept.columns == awkward(spark).columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, None}


def test_js_distance():
    p = np.array([[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    assert np.allclose(js_distance(p, np.array([1.0, 0.0])), [0, np.sqrt(0.311278), 1], atol=1e-5)


def test_near_duplicates_match_brute_force(spark):
    data = awkward(spark).where("doc_id is null or doc_id not in (8, 9)").select("doc_id", "text")
    base = [f"w{i}" for i in range(120)]
    rows, at = [], 100
    for group in range(3):  # chains: each text a step further from the first
        text = [f"g{group}{w}" for w in base]
        for step in range(12):
            rows.append((at, " ".join(text)))
            text[(step * 37) % 120] = f"edit{group}-{step}"
            at += 1
    data = data.union(spark.createDataFrame(rows, "doc_id long, text string")).union(
        spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in data.collect() if r["doc_id"] is not None}
    component, size = near_components(texts)
    got = near_duplicates(data.withColumn("component_id", data["doc_id"])).collect()
    assert len(got) == data.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == component[r["doc_id"]] and r["n_shingles"] == size[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    from lodeworks.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # one crowd of texts that are partly linked to each other
        text = list(base)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            text[at] = f"e{rng.integers(0, 9)}"
        rows.append((i, " ".join(text)))
    component, _ = near_components(dict(rows))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == component


def test_blocks_compare_all_pairs_of_first_components():
    from lodeworks.llm.neardup import _closer

    label = [0] * 2 + [2] * 5 + [7] * 8 + [15] * 10
    texts = [" ".join(f"t{i}w{j}" for j in range(9)) for i in range(25)]
    texts[15], texts[7], texts[6] = texts[0], texts[2], texts[1]
    found = _closer(85)(pa.table({"doc_id": range(25), "component": label, "text": texts})).to_pylist()
    joined = {x: x for x in label}
    for r in found:
        a, b = joined[label[r["a"]]], joined[label[r["b"]]]
        joined = {k: a if v == b else v for k, v in joined.items()}
    assert len(set(joined.values())) == 1


def test_near_duplicates_of_no_rows(spark):
    assert near_duplicates(awkward(spark).limit(0)).count() == 0
    assert near_duplicates(awkward(spark).where("doc_id in (3, 4, 5)")).where("kept and n_shingles = 0").count() == 3


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(pool[:800]), np.unique(pool[100:])
    signed = signatures([a, b], 400)
    assert abs((signed[0] == signed[1]).mean() - 700 / 900) < 0.08


def test_substrings_of_rows_without_or_with_equal_ids(spark):
    """Rows are told apart by their text; 2,000 without an id are not joined with each other."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(f'n{i}x{j}' for j in range(30))} {passage if i % 5 == 0 else 'q%d' % i}" for i in range(2000)]
    texts += [texts[3]] * 200 + [passage + " end"] * 3 + [" \n ".join(texts[4].split())]
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)]
    got = Counter((r["n_removed"], r["kept_sha256"]) for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter((n, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for kept, n in cut_repeats(texts))
    assert got == want


def test_substrings_match_brute_force(spark):
    data = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    long = " ".join(f"p{i}" for i in range(50))
    more = [
        (5000, long + " q " + long), (5001, "start " + long), (5002, "a a a a " * 30), (5003, "z " * 36),
        (5004, "z " * 35), (5005, " ".join(f"only{i}" for i in range(35))), (5000, "other " + long + " text"),
        (None, long + " unnamed"), (5006, " ".join(f"p{i}" for i in range(34))),
    ]
    data = data.union(spark.createDataFrame(more, "doc_id long, text string")).union(
        awkward(spark).select("doc_id", "text"))
    rows = data.collect()
    expected = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], len(words(r["text"])), gone,
         hashlib.sha256(" ".join(kept).encode()).hexdigest())
        for r, (kept, gone) in zip(rows, cut_repeats([r["text"] for r in rows])))
    got = remove_repeats(data.withColumn("digest", data["text"])).collect()
    assert expected == sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert remove_repeats(data.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_bpe_matches_the_library(spark, library):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += [r["text"] or "" for r in awkward(spark).collect()]
    texts += ["<|endoftext|>a<|startoftext|>", "I'll we've 12½ ΣΣς", "İǅ éẛ̣"]
    codec = Codec(read_vocabulary(VOCABULARY))
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == known.ids
        assert codec.decode(known.ids) == library.decode(known.ids, skip_special_tokens=False)


def test_bpe_of_every_code_point(library):
    codec = Codec(read_vocabulary(VOCABULARY))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1b{c}" for c in points[::3]]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == known.ids, ascii(text)


def test_bpe_pairs_are_tested_exactly(library):
    codec = Codec(read_vocabulary(VOCABULARY))
    for n in range(1, 40):  # runs of one letter meet equal merges
        for letter in "a!0z":
            assert codec.encode(letter * n) == library.encode(letter * n, add_special_tokens=False).ids


def test_bpe_keeps_what_a_word_shares_with_the_one_before(library):
    codec = Codec(read_vocabulary(VOCABULARY))
    words = ["sharing", "shared", "share", "shareable", "", "zebra", "zebras", "zebra", "été", "étés", "a" * 30]
    for word in [*words, *sorted(words), *words[::-1]]:
        assert codec.encode(word) == library.encode(word, add_special_tokens=False).ids
    codec.forget()
    codec.encode("interesting")
    before = list(codec._states)
    codec.encode("interested")
    shared = [a is b for a, b in zip(before, codec._states)]
    assert len(codec._states) == 10 and all(shared[:8]) and not shared[8]
    codec.forget()
    assert not codec._states and not codec._last and not codec._word


def test_bpe_words_of_a_slice_are_encoded_together(library, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeinrstlou\u00e9\u00f1\u00c0", k=rng.randint(1, 14))) for _ in range(4000)]
    words += ["x1y22", "a--b!?", "\u00dcBER\u00d7\u00f7\u00df", "\u00c3\u0083", "z" * 48, "b" * 24 + "\u00e9" * 12, "\x1c\x7f0", "_A_"]
    odd = ["it's", "WE'LL", "!'s", "<|endoftext|>", "a<|ENDOFTEXT|>b<|startoftext|>", "<b>", "H\u0331", "\u212a", "\u03a3\u03a3", "q" * 49, "  x "]
    codec = Codec(read_vocabulary(VOCABULARY))
    one_by_one = []
    plain = codec.encode_symbols
    monkeypatch.setattr(codec, "encode_symbols", lambda s: one_by_one.append(s) or plain(s))
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 1000)
    for parts in (sorted(words), words + odd, odd, [""], []):
        sizes, ids = codec.encode_parts(parts)
        known = [x.ids for x in library.encode_batch(parts, add_special_tokens=False)]
        ends = [0, *sizes.cumsum().tolist()]
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == known
    assert {len(x) for x in one_by_one} == {49}


def test_bpe_parts_come_sorted():
    texts = pa.array(["b a, b", None, "ü a  c", ""])
    codes, first, parts = _parts(texts)
    assert parts == sorted(parts) and len(set(parts)) == len(parts)
    own = [[parts[c] for c in codes[low:high]] for low, high in zip(first, first[1:])]
    assert ["".join(t) for t in own] == [t or "" for t in texts.to_pylist()]


def test_bpe_on_tables(spark, library):
    data = awkward(spark)
    ids = encode_documents(data, VOCABULARY)
    back = {r["doc_id"]: r["text"] for r in decode_documents(ids, VOCABULARY).collect()}
    digests = {r["doc_id"]: r for r in token_digests(data, VOCABULARY).collect()}
    for row in data.collect():
        known = library.encode(row["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(known, skip_special_tokens=False)
        assert back[row["doc_id"]] == decoded
        found = digests[row["doc_id"]]
        assert found["n_tokens"] == len(known)
        assert found["ids_sha256"] == hashlib.sha256(" ".join(map(str, known)).encode()).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert token_digests(data.limit(0), VOCABULARY).count() == 0


def test_workers_hold_one_codec_and_no_pieces_after_a_task(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('word', id, ' and more') text").repartition(8)
    for _ in range(3):  # a broadcast of its own each time
        assert encode_documents(docs, VOCABULARY).count() == 400

    def held(batches):
        for _ in batches:
            pass
        codecs = [made for _, made in scanner._HELD if isinstance(made, Codec)]
        cached = sum(len(c._new) + len(c._old) + len(c._tests) for c in codecs)
        yield pa.RecordBatch.from_pydict({"codecs": [len(codecs)], "cached": [cached]})

    rows = spark.range(64).repartition(16).mapInArrow(held, "codecs long, cached long").collect()
    assert {(r.codecs, r.cached) for r in rows} <= {(0, 0), (1, 0)}


def test_slices_bound_what_a_worker_holds():
    texts = pa.array(["a sentence of words " * 500] * 800)  # 8 MB
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert max(s.column(0).nbytes for s in scanner.slices([batch], "text")) < 1.1 * 2**20
