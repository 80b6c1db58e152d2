import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heldout.functions.materialize import checkpoint_root
from heldout.llm import chat, decontaminate, quality_rules, sharding, warc
from heldout.llm.text import WordHash, shingle_set
from tests.llm.fixtures import documents, empty, shingles, words


def windows(text):
    w = (text or "").encode().split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    return w, len({p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)})


def test_rules_count_as_defined(spark):
    docs = documents(spark)
    rows = quality_rules.judge(docs).collect()
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        w, repeated = windows(text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        chars = sum(len(x.decode()) for x in w)
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        want.append((r["doc_id"] or -1, len(w), chars, symbols, len(lines) - len(set(lines)), repeated, failed))
    assert sorted((r["doc_id"] or -1, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows) == sorted(want)
    assert not any(r["kept"] for r in rows if r["base_failed"]) and any(r["kept"] for r in rows)
    assert quality_rules.judge(empty(spark)).count() == 0
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in rows if r["kept"])


def test_rule_order_changes_no_verdict(spark):
    whole = quality_rules.measured(documents(spark).select("doc_id", "text"))
    names = list(quality_rules.RULES)
    a, b = (sorted(map(repr, whole.select("doc_id", quality_rules.cascade(o).alias("k")).collect())) for o in (names, names[::-1]))
    assert a == b
    plan = whole._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("threshold", [0.75, 1.0])
def test_contained_items_equal_brute_force(spark, threshold):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(14, 60))) for i in range(12)] + [(20, "one two three"), (21, ""), (22, None), (None, words(rng, 20))]
    items.append((23, words(rng, 700)))
    texts = []
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        cut = " ".join(w[: int(len(w) * rng.choice([0.5, 0.8, 0.9, 1]))])
        texts.append((100 + i, words(rng, rng.choice([0, 30, 9000])) + " " + cut + " " + words(rng, rng.choice([0, 40]))))
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"))
    benchmark = spark.createDataFrame([*items, items[0]], "item_id bigint, text string")
    want = sorted(
        repr((r["doc_id"], i, len(s), len(s & d))) for r in docs.collect() for i, t in items
        for s, d in [(shingles(t), shingles(r["text"]))] if s and len(s & d) >= threshold * len(s)
    )
    got = decontaminate.contained_items(docs, benchmark, threshold)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want and len(want) > 6
    small = [b for b in decontaminate.item_blocks(benchmark, per_block=200)]
    assert len(small) > 3 and sum(map(len, small)) == len(items)
    hit = {r["doc_id"] for r in got.collect()}
    assert {r["doc_id"] for r in decontaminate.clean(docs, benchmark, threshold).collect()} == {r["doc_id"] for r in docs.collect()} - hit
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contained_items(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == docs.count()


@pytest.mark.parametrize("n", [5, 6, 7, 8])
def test_items_of_few_shingles_are_all_found(n):
    rng = random.Random(n)
    items = [words(rng, n) for _ in range(600)]
    index = decontaminate.ItemIndex([shingle_set(WordHash(), t.encode()) for t in items], 0.75)
    texts = [f"{words(rng, rng.choice((0, 3, 40)))} {t} {words(rng, rng.choice((0, 5, 60)))}" for t in items]
    found = [index.search([t.encode()], WordHash())[0] for t in texts]  # one by one: each at the start of a group
    assert found == [[(k, n - 4)] for k in range(600)]
    together = index.search([t.encode() for t in texts], WordHash())
    assert together == found


def test_shards_are_even_and_mixed(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("tëxt "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    rows = sharding.interleave(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(5000))
    by_shard = {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        text = f"tëxt {r['doc_id']}".encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "rows" and r["grown_shard"] is None
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(by_shard) == list(range(24))
    counts = [len(x) for x in by_shard.values()]
    assert max(counts) - min(counts) <= 1
    total = Counter(source.values())
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        mixture = Counter(source[r["doc_id"]] for r in part)
        assert all(abs(mixture[s] - n / 24) <= 2 for s, n in total.items())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_repeated_words_where_hashes_collide(spark, monkeypatch):
    """All windows share one hash: their words alone decide, so the counts stay those of brute force."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 2, 3, 4, 9, 40, 200)] + ["a b c a b c a", "x y z", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = []
    for t in texts:
        w = (t or "").split()
        seen = Counter(zip(w, w[1:], w[2:]))
        want.append(len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    for hashed in (quality_rules.WINDOW_HASH, "cast(1 AS bigint)", "length(get(_words, i)) + ascii(get(_words, i + 2)) % 2"):
        monkeypatch.setattr(quality_rules, "WINDOW_HASH", hashed)
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measured(docs).select("doc_id", "n_repeat_words").collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_shards_equal_their_sql(spark, tmp_path):
    from heldout.llm.queries import ORACLE, QUERIES
    from tests.oracle import compare, connect

    documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "sql").mkdir()
    con = connect(str(tmp_path / "sql"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(spark, con, "op8", QUERIES["op8_sharding"], ORACLE["op8_sharding"], str(tmp_path)).startswith("ok")


def test_shards_of_awkward_rows(spark):
    docs = documents(spark)
    rows = sharding.interleave(docs, shards=5).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.interleave(empty(spark)).count() == 0
    few = sharding.interleave(docs.limit(3)).collect()
    assert len({r["shard"] for r in few}) == 3 and all(r["slot"] == 0 for r in few)


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more")]
    turns += [(4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 1, "assistant", "other"), (5, 0, "user", "hi"), (5, 0, "user", "hi")]
    turns += [(6, 0, None, None), (7, 0, "", None), (7, None, "system", ""), (None, 0, "user", "lost"), (8, 0, "user", ""), (9, 0, "user", None)]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, n_turns int, hash string")
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(got) == {3, 4, 6, 7, 8}
    assert got[3]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[4]["n_copies"] == 2 and got[4]["n_turns"] == 2 and got[8]["n_copies"] == 2
    assert got[7]["rendered"].startswith("<|im_start|>system")
    assert chat.render(df.limit(0)).count() == 0


def test_archives_give_back_every_payload(spark):
    rng = random.Random(6)
    big = "<p>" + "".join(rng.choice("aé日b\r\n") for _ in range(90_000))
    same = "<html>" + "x" * 2000
    pages = [(1, "http://a", same), (2, "http://b", same), (3, "http://c\r\nx", same), (4, None, "small"), (5, "u", "small"), (6, "u", None), (7, "u", "")]
    pages += [(8, "http://big", big), (9, "http://big2", big), (8, "http://big", big), (9, "http://big2", big), (None, "n", "y" * 1500), (None, None, None), (10, "w", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, sha string, to_id int").repartition(2)
    rows = warc.round_trip(df).collect()
    expected = []
    for i, _, html in pages:
        payload = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(payload) >= 1000 and i is not None and top is not None and i != top
        expected.append(repr((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(repr(tuple(r)) for r in rows) == sorted(expected)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_records_follow_the_format_and_faults_are_found(spark):
    payload = bytes(random.Random(2).randrange(256) for _ in range(100_000))
    parts = warc.records(1, "http://a", payload, "00", None)
    assert len(parts) == 4
    parsed = list(warc.parse(b"".join(p + b"\r\n\r\n" for p in parts)))
    assert [f.get("warc-segment-number") for f, _ in parsed] == ["1", "2", "3", "4"]
    assert warc.payload_of(b"".join(b for _, b in parsed)) == payload
    assert int(parsed[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in parsed)
    with pytest.raises(ValueError):
        list(warc.parse(parts[0][:-3] + b"\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    path = f"{checkpoint_root(spark)}/broken"
    lines = spark.createDataFrame([(p,) for k, p in enumerate(parts) if k != 2], "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="segments missing"):
        warc.read_archive(spark, path).collect()
    assert os.path.isabs(path.removeprefix("file:"))
