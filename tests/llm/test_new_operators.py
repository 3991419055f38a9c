"""Conversation trie, quality and manifest against plain versions, held-out labels, and edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvia.llm import conversation_trie, decontamination, html_extraction, merkle_manifest, quality
from fluvia.llm._common import numbered

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, part string, n string, idx string"
TALK = "conv_id long, turn long, role string, text string, depth string, size string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


# conversation trie
def plain_trie(rows: list[dict]) -> collections.Counter:
    own = collections.defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            own[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0), (r["role"] or "", r["text"] or "")))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
    ends = lambda p: sha(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))))
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def test_trie_equals_a_plain_one(spark):
    got = conversation_trie.op11_conversation_trie(spark, SF)
    rows = local(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(rows)


@pytest.mark.parametrize("least", [2, 10_000])
def test_upper_levels_and_shards_give_the_same_trie(spark, least):
    """A first turn that half of the conversations share, copies, conversations that are beginnings of others, long ones."""
    draw = random.Random(7)
    rows = []
    for c in range(200):
        first = "hello there" if c % 2 else draw.choice("abc")
        texts = [first] + [draw.choice(["yes", "no", "a b c"]) for _ in range(draw.randrange(6))]
        if c in (60, 61, 62):
            texts = ["copy"] * 9000 + [str(c)]
        if c % 7 == 0:
            texts = ["one", "two", "three"]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", t, "x", "y", "z") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, TALK)
    got = conversation_trie.trie(*conversation_trie.rebuilt(d), least_upper=least)
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(local(d))


def test_trie_of_odd_conversations(spark):
    """Null turns come first, null roles and texts are empty, rows without a conversation go, repeated rows are turns, ids may be negative."""
    rows = [(20, None, None, None), (20, 3, "user", "b"), (20, -1, "user", ""), (21, 0, "user", " \n"), (21, 0, "user", " \n"), (None, 0, "user", "nobody"), (-3, 0, "user", "long " * 50_000), (-25, 1, None, "x"), (7, 0, "a", "b")]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TALK)
    got = conversation_trie.trie(*conversation_trie.rebuilt(d))
    assert collections.Counter(map(tuple, got.collect())) == plain_trie(local(d))
    assert conversation_trie.trie(*conversation_trie.rebuilt(d.limit(0))).count() == 0


def test_a_conversation_without_turns_belongs_to_the_root_only(spark):
    c = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)  # begins with three turns of a conversation that isn't there
    d = spark.createDataFrame([(c, 0, "user", "a", "", "", "")], TALK)
    (row,) = conversation_trie.trie(*conversation_trie.rebuilt(d)).collect()
    assert tuple(row) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))


def test_level_order_bits_are_walked(spark):
    nodes = pd.DataFrame([(1, 0, 9, 9, 1), (2, 0, 9, 9, 1), (3, 0, 1, 0, 2), (4, 0, 1, 0, 2), (5, 0, 4, 0, 3)], columns=["k1", "k2", "p1", "p2", "depth"])
    nodes = nodes.assign(shard=0, **{c: 0 for c in ("conv_id", "n_convs", "words", "n_ends", "an_end", "below_children", "below_leaves", "below_saved")})
    row = conversation_trie.build(nodes.sample(frac=1, random_state=1)).to_dict("records")[0]
    bits, has = conversation_trie.decoded(row)
    assert has["k1"].tolist() == [1, 2, 3, 4, 5] and has["p1"].tolist() == [9, 9]
    assert bits.degree.tolist() == [2, 2, 0, 0, 1, 0] and bits.parent[1:].tolist() == [0, 0, 1, 1, 4]
    assert bits.levels() == [(1, 3), (3, 5), (5, 6)] and bits.first_child[[0, 1, 4]].tolist() == [1, 3, 5]


def test_ends_of_hot_nodes_are_joined_in_order(spark):
    ends = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("k1"), F.lit(2).cast("long").alias("k2"), F.col("id").alias("conv_id"))
    want = collections.defaultdict(list)
    for r in local(ends):
        want[r["k1"]].append(r["conv_id"])
    got = {r["k1"]: r["digest"] for r in conversation_trie.end_digests(ends).collect()}
    assert got == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}


# numbering
def test_rows_are_numbered_in_ranges(spark):
    rows = [("a" if i % 3 else None, (i * 7919) % 1000) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g string, v long"), ["g"], [F.col("v")], "test").toPandas()
    for _, part in got.fillna({"g": ""}).groupby("g"):
        part = part.sort_values("idx")
        assert part["idx"].tolist() == list(range(len(part))) and (part["n"] == len(part)).all() and part["v"].is_monotonic_increasing
    assert got["part"].nunique() > 3


# manifest
def plain_levels(digests: list[str]) -> list[list[str]]:
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for row in levels[:-1]:
        run = i - i % 16
        out.append((row[run:i], row[i + 1 : run + 16]))
        i //= 16
    return out


def plain_manifest(rows: list[dict]) -> collections.Counter:
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(part(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + part(text))
    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        of[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: plain_levels([leaf(r, r["text"]) for r in of[s]]) for s in names}
    crown = plain_levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(of[s]):
            way, now = plain_way(trees[s], i) + plain_way(crown, j), trees[s][0][i]
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in way:
                now = sha("".join(left) + now + "".join(right))
            root = crown[-1][0]
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in way)), now, now == root))
    return collections.Counter(out)


def test_manifest_equals_a_plain_one(spark):
    got = merkle_manifest.op13_merkle_manifest(spark, SF)
    rows = local(spark.read.parquet(f"{SF}/documents.parquet"))
    assert collections.Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_a_hot_source_many_sources_and_odd_rows(spark):
    """A source of three levels and more, hundreds of sources, lone leaves, nulls in every column, repeated rows and ids, a long text."""
    rows = [(i, f"Text {i}", "en", "hot", 6) for i in range(9001)] + [(i, "A", None, f"s{i}", 1) for i in range(300)]
    rows += [(None, "Null id", "en", "hot", 7), (None, None, None, None, None), (3, None, "de", None, 0), (3, "", "de", None, 0), (5, "Ä Z " * 50_000, "de", "ß", 4)] + [(5, "TWICE", "de", "ß", 4)] * 2 + [(6, "x", "de", "", 4)]
    d = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOC)
    assert collections.Counter(map(tuple, merkle_manifest.manifest(d).collect())) == plain_manifest(local(d))
    assert merkle_manifest.manifest(d.limit(0)).count() == 0
    (one,) = merkle_manifest.manifest(d.where("source = 's7'")).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


def test_forests_may_be_merged_in_any_order():
    nodes = [("g", 300, 0, i, sha(str(i))) for i in range(300)]
    want = plain_levels([n[-1] for n in nodes])
    for seed in range(3):
        mixed = nodes[:]
        random.Random(seed).shuffle(mixed)
        left, right, done = merkle_manifest.Forest(), merkle_manifest.Forest(), []
        for n in mixed[:170]:
            done += left.add(*n)
        for n in mixed[170:]:
            done += right.add(*n)
        for n in left.open_nodes():
            done += right.add(*n)
        assert not list(right.open_nodes()) and sorted(done) == sorted((level, i, v) for level, row in enumerate(want) if level for i, v in enumerate(row))


# quality
def test_quality_is_right_for_held_out_documents(spark):
    got = quality.op12_quality(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    seen = got.merge(labels, on="doc_id")
    seen = seen[seen["held_out"]]
    assert len(seen) > 80 and (seen["predicted"] == seen["quality"]).mean() > 0.97


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    described = quality.features(docs)
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(described, labels) == quality.learn(described, other)


def plain_features(text: str | None) -> list[float]:
    text = text or ""
    raw, words = text.encode(), text.lower().split()
    solid = max(1, len(raw) - sum(b <= 32 for b in raw))
    count = lambda chars: sum(b in chars.encode() for b in raw)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    known = ".,;:?'\"-()!|0123456789"
    other = sum(32 < b < 128 and not chr(b).isalpha() and chr(b) not in known for b in raw)
    n, again = max(1, len(words)), sum(a == b for a, b in zip(words, words[1:], strict=False))
    rates = [upper / max(1, upper + lower), count("0123456789") / solid, count(".,;:?'\"-()") / solid, count("!") / solid, count("|") / solid, other / solid, raw.count(b"\n") / n, sum(b >= 128 for b in raw) / solid]
    return [*[r**0.5 for r in rates], np.log1p(solid / n) if words else 0.0, np.log1p(len(set(words))) / np.log1p(n) if words else 0.0, (again / n) ** 0.5, np.log1p(len(words))]


def test_features_equal_plain_ones():
    texts = [None, "", " \n\t", "A | b || 12!", "the the the End.", "éß ÀÉ $$$ ~~ x\ny", "one two " * 40_000, "same", "same"]
    got = quality.describe(pa.array(texts, type=pa.string()))
    assert np.allclose(got, [plain_features(t) for t in texts])
    assert np.allclose(quality.describe(pa.array(["zzz", *texts], type=pa.string())[1:]), got)  # a slice with an offset


def test_pairs_rank_and_the_quantile_divides():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 2] - 0.5 * x[:, 5] > 0.4).astype(int)
    model = quality.fit(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    s = x @ np.array(model.weights)
    assert ((s >= model.threshold) == (y == 1)).mean() > 0.99
    # the loss has its least value there: a plain gradient of the pairs is 0
    good, bad = x[y == 1] / x.std(axis=0), x[y == 0] / x.std(axis=0)
    w = quality.fit_pairs(good, bad, pairs=2)
    rng = np.random.default_rng(0)
    left = np.concatenate([np.repeat(np.arange(len(good)), 2), rng.integers(0, len(good), 2 * len(bad))])
    right = np.concatenate([rng.integers(0, len(bad), 2 * len(good)), np.repeat(np.arange(len(bad)), 2)])
    slope = sum((good[i] - bad[j]) / (1 + np.exp((good[i] - bad[j]) @ w)) for i, j in zip(left, right, strict=True)) - quality.RIDGE * w
    assert np.abs(slope).max() < 1e-5
    assert quality.quantile(np.array([4.0, 1.0, 2.0, 3.0]), np.ones(4), 0.5) == 2.5


def test_quality_of_odd_documents(spark):
    """One label only, no labels, null labels, repeated labels, null ids and texts, clashing columns, no documents."""
    rows = [(1, None), (2, ""), (3, "good words here."), (4, "BAD!! WORDS!!"), (4, "BAD!! WORDS!!"), (None, "no id"), (6, "long " * 100_000)]
    d = spark.createDataFrame([(i, t, "en", "a", 1, "x", "y", "z", "w") for i, t in rows], DOC).withColumns({"upper": F.lit("u"), "score": F.lit("s")})
    labels = lambda x: spark.createDataFrame(x, "doc_id long, quality long, text string")
    described = quality.features(d)
    for known in ([], [(3, 1, "t")], [(3, None, "t"), (None, None, "t")], [(4, 0, "t"), (4, 0, "t")], [(3, 1, "t"), (4, 0, "t"), (6, 1, "t"), (2, 0, "t")]):
        got = quality.score(described, quality.learn(described, labels(known))).toPandas()
        assert len(got) == 7 and got["score"].between(0, 1).all() and got.groupby("doc_id")["score"].nunique().max() == 1
    assert quality.score(quality.features(d.limit(0)), quality.Model([0.0] * 12, 0.0)).count() == 0


def test_quality_learns_from_all_labelled_documents(spark, monkeypatch):
    """Every label tells: no bound on documents changes the model, and as many scores as there are bad documents lie below the threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 > 2).cast("long").alias("quality"))
    described = quality.features(docs)
    model = quality.learn(described, labels)
    monkeypatch.setattr(quality, "MAX_TRAIN", 20, raising=False)
    assert quality.learn(described, labels) == model
    rows = described.join(labels, "doc_id").where(~quality.held_out(F.col("doc_id"))).toPandas()
    scores = rows[quality.FEATURES].to_numpy() @ np.array(model.weights)
    assert (scores < model.threshold).sum() == (rows["quality"] == 0).sum()


# HTML extraction
def test_text_beside_the_content_is_kept_and_clusters_decide(monkeypatch):
    """A short end beside the long box stays; without the clusters menus that only names tell come through."""
    long = "long text here " * 20
    assert html_extraction.main_text(f"<div><h1>T</h1><p>{long}</p></div><p>Short end.</p>") == f"T {long.strip()} Short end."
    page = f"<body><div class='menu'><p>{long}</p></div><div><h1>T</h1><p>{long}</p></div><div class='footer'>Imprint</div><p>Short <b>end</b>.</p></body>"
    assert html_extraction.main_text(page) == f"T {long.strip()} Short end."
    with monkeypatch.context() as m:
        m.setattr(html_extraction, "content_lines", lambda own: (np.ones(len(own), dtype=bool), 0.0))
        assert "Imprint" in html_extraction.main_text(page)


# decontamination
def test_alignments_do_not_depend_on_what_is_kept_in_memory(monkeypatch):
    """Ways traced block by block are those of the ways kept whole; a long item needs no square of memory."""
    draw = random.Random(0)
    item = [draw.choice(["alpha", "beta", "gamma", "delta", "12", "Name"]) for _ in range(120)]
    texts = []
    for _ in range(30):
        words = [draw.choice(["7", "Other"]) if w in ("12", "Name") and draw.random() < 0.3 else w for w in item]
        for _ in range(draw.randrange(6)):
            words.insert(draw.randrange(len(words)), "foo")
            words.pop(draw.randrange(len(words)))
        texts.append("some words " + " ".join(words[: draw.randrange(60, 121)]) + " and more")
    parsed, (known, _) = [decontamination.templates([t])[0] for t in texts], decontamination.templates([" ".join(item)])
    whole = [decontamination.aligned(d, known) for d in parsed]
    assert 5 < sum(x is not None for x in whole) <= 30
    monkeypatch.setattr(decontamination, "CELLS", 500)
    assert [decontamination.aligned(d, known) for d in parsed] == whole
    monkeypatch.undo()
    lattice = decontamination._Lattice(decontamination.templates([" ".join(item * 10)])[0], decontamination.templates([" ".join(item * 10)])[0])
    monkeypatch.setattr(decontamination, "CELLS", 50_000)
    tracemalloc.start()
    bent = decontamination._Bent(lattice)
    assert bent.counts.max() == 1200 and (bent.trace(np.array([1199]))[:, 0] == 1199).all()
    assert tracemalloc.get_traced_memory()[1] < 1200 * 2400 * 2
    tracemalloc.stop()
