import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SMALL
from corpus import awkward
from tokenizers import Tokenizer

from lodeworks.llm import alignment
from lodeworks.llm.alignment import PairHash, align_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def libraries():
    """(ids, token bytes) of whole texts by the libraries themselves."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    letter = {**{chr(x): x for x in plain}, **{chr(256 + i): x for i, x in enumerate(rest)}}

    def both(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return (
            [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids_a],
            [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
              b.id_to_piece(i).replace("▁", " ").encode()) for i in ids_b])

    return both


def brute_force(rows, both):
    """One tuple per row, from whole texts and all links."""
    made, counts = [], Counter()
    for doc_id, text in rows:
        a, b = both(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            a, b = [], []
        ends = [set(np.cumsum([len(t) for _, t in x]).tolist()) for x in (a, b)]
        common = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in common]
        for side, tokens in enumerate((a, b)):
            at = g = 0
            for i, t in tokens:
                groups[g][side].append(i)
                at += len(t)
                g += at == common[g]
        links = [(x, y) for left, right in groups for x in left for y in right]
        counts.update(set(links))
        made.append((doc_id, len(a), len(b), groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted(((
        doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[0]] for p in links),
        sum(counts[p] for p in links),
        ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        for doc_id, n_a, n_b, groups, links in made), key=str)


def result(docs, **more):
    rows = align_documents(docs, A, B, **more)
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS), r[rows.columns[-1]]) for r in rows.collect()), key=str)


def test_alignment_equals_brute_force_on_the_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    assert result(docs) == wanted
    digests = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in wanted]
    assert result(docs, digests=True) == sorted(digests, key=str)


def test_alignment_of_awkward_texts_in_one_and_in_several_rounds(spark, libraries, monkeypatch):
    docs = awkward(spark)
    texts = [
        (20, " two  spaces   before \n  a line\n\n end "), (21, " "), (22, "  "), (23, "\t"), (24, "a \n  b"),
        (25, "é à l'été ﬁn ½ 　wide　 space"), (26, "<s> </s> <unk> <0x41> <|endoftext|> ▁ x▁y"),
        (27, "東京タワー 한국어 ​ zero"), (28, "I'll it's 'S 12345 $$$ ..."), (29, "퟿ \U0010ffff")]
    more = spark.createDataFrame(texts, "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    wanted = brute_force([tuple(r) for r in rows.collect()], libraries)
    assert result(docs.unionByName(more, allowMissingColumns=True)) == wanted
    monkeypatch.setattr(alignment, "ROUND_KEYS", 100)
    assert result(rows) == wanted
    assert result(rows.limit(0)) == []
    assert result(rows.where("text is null"))[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_wide_groups_are_linked_by_distinct_ids(monkeypatch):
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        aligner = alignment.Aligner((a.read(), b.read()))
    texts = pa.array(["unbelievably xkcdqwerty zzyzx", None, "xkcdqwerty 0x7fffffff aaaaaaaaaaaaaaaaab"])
    plain = aligner.align(texts)
    monkeypatch.setattr(alignment, "_WIDE", 1)
    wide = aligner.align(texts)
    assert plain.n_links.tolist() == wide.n_links.tolist()
    for u in range(len(plain.n_a)):
        one, other = Counter(), Counter()
        for found, total in ((plain, one), (wide, other)):
            own = slice(found.key_first[u], found.key_first[u + 1])
            for key, n in zip(found.keys[own].tolist(), found.times[own].tolist()):
                total[key] += n
        assert one == other and sum(one.values()) == plain.n_links[u]


def test_parts_are_handed_on_when_they_grow(monkeypatch):
    keys = [np.arange(i, 400 + i) for i in range(5)]
    found = alignment._merged([(k, np.ones(len(k), np.int64)) for k in keys])
    rows = alignment._part_rows(*found, 3)
    got = dict(zip(rows["keys"].flatten().to_pylist(), rows["counts"].flatten().to_pylist()))
    assert got == Counter(np.concatenate(keys).tolist())


def test_pair_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 20_000))
    made = PairHash.unpacked(PairHash.build(keys).packed())
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    assert PairHash.build(keys[:0]).size == 0 and PairHash.build(keys[:1]).slots(keys[:1]).tolist() == [0]
