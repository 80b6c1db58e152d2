import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heldout.llm import packing, token_counts
from heldout.llm.pieces import Pieces
from heldout.llm.queries import vocabulary_path
from tests.llm.fixtures import documents, empty


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(numbers):
    return b"".join(x.to_bytes(4, "little") for x in numbers)


def test_pieces_equal_the_library(library):
    rng = random.Random(4)
    latin = [chr(c) for c in range(1, 0x180)]
    odd = ["日", "Σ", "ς", "é", "İ", "ﬁ", "½", "٣", " ", "😀", "K", "Ɓ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = [f"a{c}b1{c}'{c}s don't'll" for c in latin]
    texts += ["".join(rng.choice(latin + list("abc 's'tre") * 8) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(latin + odd * 8) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    pieces = Pieces(vocabulary_path(), most=50)
    for text in texts:
        want = packed(ids(library, text))
        assert pieces.ids(text) == want
        assert b"".join(map(pieces.encode, pieces.pretokens(text))) == want


@pytest.mark.parametrize("frequent", [3, 10_000])
def test_counts(spark, library, frequent):
    docs = documents(spark)
    got = token_counts.count_tokens(docs, vocabulary_path(), frequent=frequent).collect()
    want = sorted(((r["doc_id"] or -1, len((r["text"] or "").encode()), len(ids(library, r["text"]))) for r in docs.collect()))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.count_tokens(empty(spark), vocabulary_path()).count() == 0


def test_packing_holds_every_id_once(spark, library):
    docs = documents(spark)
    rows = packing.pack(docs, vocabulary_path(), with_ids=True).collect()
    want = sorted(packed([*ids(library, r["text"]), packing.END]) for r in docs.collect())
    seen, by_sequence = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 <= packing.CONTEXT
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert sum(map(len, (p for one in seen.values() for _, p in one))) == sum(map(len, want))
    each = lambda raws: Counter(raw[i : i + 4] for raw in raws for i in range(0, len(raw), 4))
    assert each(p for one in seen.values() for _, p in one) == each(want)
    single = {k: v for k, v in seen.items() if k[0] not in (None, 3)}
    for (_, total), parts in single.items():
        whole = b"".join(p for _, p in sorted(parts))
        assert len(whole) == 4 * total and whole in want
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CONTEXT
    assert packing.pack(empty(spark), vocabulary_path()).count() == 0


def test_patterns_place_longest_first_and_leave_little_room():
    rng = random.Random(8)
    histogram = {n: rng.randint(1, 400) for n in rng.sample(range(1, 4097), 900)}
    found = packing.patterns(histogram)
    placed = {}
    for n, pattern in found:
        lengths = [x for x, _ in pattern]
        assert lengths == sorted(lengths, reverse=True) and sum(a * b for a, b in pattern) <= 4096
        for length, times in pattern:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram
    total = sum(a * b for a, b in histogram.items())
    assert sum(n for n, _ in found) * 4096 < 1.03 * total
    assert packing.patterns({100: 41}) == [(1, ((100, 40),)), (1, ((100, 1),))]


def test_one_length_with_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.pack(docs, vocabulary_path())
    assert rows.select("sequence_id").distinct().count() == 3 and rows.select("sequence_id", "offset").distinct().count() == 3000
