import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heldout.llm import alignment
from tests.llm.fixtures import documents, empty, words

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    """The published printable letters of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def groups_of(text):
    """[(A ids, B ids)] of each group, by walking the ends as sets."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    if not text:
        return []
    table = letters()
    encoded = a.encode(" " + text, add_special_tokens=False)
    sides = [[(i, bytes(table[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)], []]
    for i in b.encode(text):
        p = b.id_to_piece(i)
        sides[1].append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
        return []
    ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in sides]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for k, side in enumerate(sides):
        for (i, _), e in zip(side, ends[k]):
            out[next(g for g, c in enumerate(cuts) if e <= c)][k].append(i)
    return out


def brute(rows):
    per_row = [(i, groups_of(t)) for i, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in per_row]
    count = Counter(p for c in links for p in c)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for (i, g), c in zip(per_row, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), hashlib.sha256(text.encode()).hexdigest() if g else "",
            sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
        ))
    return sorted(out, key=repr)


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = alignment.alignment_statistics(docs, *PATHS, **how)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("frequent", [0, 50, 300_000])
def test_awkward_rows(spark, frequent):
    """With none, some or all pairs held by the tasks."""
    check(documents(spark), frequent=frequent)
    assert alignment.alignment_statistics(empty(spark), *PATHS).count() == 0


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [
        "x", " ", "  two  spaces ", "a\n\n\nb\t\tc", "<s> </s> <unk> <0x41> <|endoftext|>", "▁ under ▁score", "😀😀🎉 emoji", "日本語の文章です。" * 9, "é" * 50, "\x00\x01 control",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890" * 20, "don't we'll I'm", "".join(chr(rng.randrange(0x20, 0x2FFF)) for _ in range(400)), "ﬁ ½ Å Ａ",
        "https://example.org/a/b?c=d&e=" + "f0" * 40, *[words(rng, 40) for _ in range(10)],
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))


def test_lanes_and_wide_groups_change_nothing(monkeypatch):
    """Short lanes, one lane per document and counted wide groups give the same arrays."""
    tables = alignment.token_tables(*PATHS)
    rng = random.Random(5)
    texts = [words(rng, n).encode() for n in (0, 1, 5, 3000, 40)] + ["日本語 😀 の文章".encode() * 30, b""]
    want = alignment.align_batch(texts, tables, lane=1 << 40)
    for lane in (3, 16, 256):
        assert all((x == y).all() and (e == f).all() for (x, e), (y, f) in zip(alignment.align_batch(texts, tables, lane), want))
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert all((x == y).all() and (e == f).all() for (x, e), (y, f) in zip(alignment.align_batch(texts, tables, 16), want))


def test_lockstep_against_sets():
    rng = np.random.default_rng(1)
    for _ in range(40):
        common = np.unique(rng.integers(1, 300, 12))
        a, b = (np.unique(np.concatenate((common, rng.integers(1, common[-1] + 1, 60)))) for _ in range(2))
        groups, links, wide = alignment.lockstep(a, b, np.array([0]), np.array([0]))
        cuts = np.intersect1d(a, b)
        assert (a[groups[:, 1] - 1] == cuts).all() and (b[groups[:, 3] - 1] == cuts).all() and not len(wide)
        side = lambda ends: np.searchsorted(cuts, ends)
        want = {(i, j) for i, x in enumerate(side(a)) for j, y in enumerate(side(b)) if x == y}
        assert sorted(map(tuple, links.T.tolist())) == sorted(want)


def test_ranks_give_the_ids_of_the_library():
    """Random strings of the blocks that go by ranks, white space and apostrophes often."""
    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    rng = random.Random(6)
    blocks = [(0, 0x24F), (0x391, 0x3C9), (0x400, 0x4FF), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
    common = [*" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", "'s", "'S", "'ll", " the", "'re", "<|endoftext|>", "²", "½", "_", "1", "ª"]
    texts = ["".join(rng.choice(common) if rng.random() < 0.5 else chr(rng.randint(*rng.choice(blocks))) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(chr(c) for c in range(a, b + 1)) for a, b in blocks]
    assert not any(alignment.RARE.search(t) for t in texts)
    encode = alignment.token_tables(*PATHS)[0]
    assert encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
