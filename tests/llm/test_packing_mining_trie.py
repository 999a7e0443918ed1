"""Packing, hard negatives and the prefix trie against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm import hard_negatives, packing, prefix_trie
from meterlake.llm.oracles import ORACLES
from meterlake.llm.queries import QUERIES, word_bpe

SF = "/root/testdata/sf0.001"
MORE = "rank string, leaf string, a string, length string, uid string"


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_prefix_trie"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in df.select(names).collect())


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(word_bpe())


TRICKY = ["", " ", "0 00 a0b 0", "it's 'tis I'LL Don't.", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "W̊ é é ́ a b c\x1cd\x1fe", "ΣΑΣ İI", "a_b __ 12,3.4 ½ x²", "日本語　テキスト。"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB'stm lld.,!?0179_ \x1c\x85́éÉΣσİ<|>\n\t½²日"), max_size=40) | st.text(max_size=30), min_size=1, max_size=5))
def test_ids_equal_the_tokenizers(tokenizer, words, texts):
    texts = texts + TRICKY
    got = [np.frombuffer(x, "<u4").tolist() for x in packing._texts_ids(words, pa.array(texts))]
    assert got == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_texts_are_read_in_sections_and_the_store_of_words_is_bounded(tokenizer, words, monkeypatch):
    monkeypatch.setattr(packing, "SECTION_BYTES", 50)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdé.", k=rng.randint(1, 9))) for _ in range(60)), "x" * 500, None, "y " * 90]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing._texts_ids(words, pa.array(texts))]
    assert got == [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_gives_each_piece_a_place_as_best_fit_does(counts):
    runs = packing.plan_runs(counts, 64)
    used = defaultdict(list)
    for length, n in counts.items():
        mine = runs[runs[:, 0] == length]
        for rank in range(n):
            _, first, sequence, each, offset = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            used[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b + length <= 64]
            if fits:
                bins.remove(max(fits))
            bins.append(max(fits, default=0) + length)
    assert len(used) == len(bins)
    assert set(used) == set(range(len(bins)))


def test_packing_equals_brute_force(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(rng.choice([1, 3, 20, 60])))) for i in range(120)]
    rows += [rows[3], rows[3], (None, "alone"), (500, None), (501, ""), (502, "a b " * 900)]
    for n in (63, 64, 65, 128):  # so many ids with the one at the end
        rows.append((600 + n, "a " * (n - 1)))
    docs = spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"doc_id long, text string, {MORE}").repartition(5)
    got = packing.pack(docs, word_bpe, size=64).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for start in range(0, len(ids), 64):
            want[doc_id, start // 64, start, len(ids[start : start + 64]), zlib.crc32(ids[start : start + 64].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        ends = np.cumsum([n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(places) <= 11 / 9 * math.ceil(sum(r["length"] for r in got) / 64) + 1  # of which best fit, longest first, is capable


def test_packing_a_third_of_all_rows_alike(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one and the same text', concat('t', id, repeat(' w', int(id % 50)))) as text").repartition(6)
    got = packing.pack(docs, word_bpe, size=128)
    assert got.count() == 3000
    assert got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 128").count() == 0
    assert got.select("sequence_id", "offset").distinct().count() == 3000


# --- hard negatives


def negatives(rows, k=5):
    """Every anchor against every row."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = max((len(r[1]) for r in rows), default=0)
    q = np.array([[math.floor(256 * x) for x in r[1]] + [0] * (dim - len(r[1])) for r in rows], dtype=object).reshape(len(rows), dim)
    ids = [math.inf if r[0] is None else r[0] for r in rows]
    labels = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for a in range(len(rows)):
        if rows[a][0] is None or rows[a][0] % 100:
            continue
        score = [int((q[a] * x).sum()) for x in q]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if labels[i] == labels[a]][:k]:
            met = [i for i in order if labels[i] != labels[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out += [(ids[a], rows[p][0], n + 1, rows[i][0], score[p], score[i]) for n, i in enumerate(met)]
    return Counter(out)


def vectors(seed, n=700, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i * 5, (centres[i % 8] + 0.3 * rng.normal(size=dim)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    for i in range(0, n, 3):  # a third of all vectors are the same one
        rows[i] = (rows[i][0], [0.5] * dim, rows[i][2])
    rows += [rows[0], rows[20], rows[21], (None, [0.4] * dim, 1), (7000, None, 1), (7001, [0.5] * dim, None), (7100, [0.5, None] + [0.1] * (dim - 2), 1)]
    rows += [(7200, [float("nan")] * dim, 1), (7300, [float("inf")] + [0.0] * (dim - 1), 1), (7400, [], 1), (7500, [0.9, 0.9], 2), (7700, [-0.5] * dim, 2)]
    return rows


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"vec_id long, embedding array<double>, label int, {MORE}")


@pytest.mark.parametrize("leaf_rows, cell_rows, cell_anchors", [(512, 32_768, 32_768), (8, 50, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf_rows, cell_rows, cell_anchors):
    for name, value in (("LEAF_ROWS", leaf_rows), ("CELL_ROWS", cell_rows), ("CELL_ANCHORS", cell_anchors), ("SAMPLE", 200), ("WAYS", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(1)
    assert Counter(tuple(r) for r in hard_negatives.mine(embeddings(spark, rows)).collect()) == negatives(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(2)
    rows = [(i * 20, [rng.choice([1.0, 1.0 + 2**-20, 1 + 2**-21]) * 2.0**20 for _ in range(5)], i % 2) for i in range(60)]
    assert Counter(tuple(r) for r in hard_negatives.mine(embeddings(spark, rows)).collect()) == negatives(rows)


def test_leaves_outside_the_annulus_are_left_out():
    """Of clustered vectors the tree leaves out most leaves, and never one that holds a row inside the annulus."""
    rng = np.random.default_rng(0)
    centres = 400 * rng.normal(size=(30, 8))
    rows = np.round(centres[rng.integers(0, 30, 4000)] + 20 * rng.normal(size=(4000, 8)))
    square = (rows * rows).sum(1).max()
    lifted = hard_negatives.lift(rows, square)
    root, leaves = hard_negatives.build(lifted[:1000], 2)
    ranges: dict = {}
    [batch] = hard_negatives._ranger(root, 8, square)(iter([pa.RecordBatch.from_arrays([pa.array((rows / 256).tolist())], ["vec"])]))
    for r in batch.to_pylist():
        ranges[r["node"], r["point"], r["cell"]] = (r["low"], r["high"])
    hard_negatives._set_ranges(root, ranges)
    leaf = hard_negatives._leaf_of(root, lifted)
    anchors = np.column_stack([rows[:50], np.zeros(50)])
    inner, outer = np.full((50, 1), 0.5 * square**0.5), np.full((50, 1), 0.8 * square**0.5)
    who, where = hard_negatives.surviving(root, anchors, inner, outer, 1e-3)
    far = np.sqrt(((anchors[:, None] - lifted) ** 2).sum(2))
    needed = {(i, leaf[j]) for i, j in zip(*np.nonzero((far >= inner) & (far <= outer)), strict=True)}
    visited = set(zip(who.tolist(), where.tolist(), strict=True))
    assert needed <= visited
    assert len(visited) < 0.7 * 50 * len(set(leaf.tolist()))


def test_negatives_of_an_empty_table_and_of_one_row(spark):
    assert hard_negatives.mine(embeddings(spark, [])).count() == 0
    assert hard_negatives.mine(embeddings(spark, [(100, [0.1], 1)])).count() == 0


# --- prefix trie


def trie(rows):
    """Every beginning of every rebuilt conversation."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(built):
        path = tuple(built[c])
        ends[path].append(str(c))
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    saved, leaves = Counter(), Counter()
    for path, m in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += path not in kids
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()) for p, m in members.items()
    )


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], f"conv_id long, turn long, role string, text string, {MORE}")


def talks(seed, n=90, most=14, variants=2):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randint(1, most)):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", None]) if rng.random() < 0.2 else "user", f"t{t} é {rng.randrange(variants) if rng.random() < 0.3 else 0}"))
    rows += [(None, 1, "user", "nobody's"), (400, 1, None, None), (401, None, "", ""), (403, 2, "user", "x" * 9000)]
    rows += [(c, t, "user", f"copied {t}") for c in range(500, 560) for t in range(6)]  # a large group of copies
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    rows = talks(seed)
    assert Counter(tuple(r) for r in prefix_trie.build_trie(conversations(spark, rows)).collect()) == trie(rows)


def test_long_conversations_are_carried_from_part_to_part(spark, monkeypatch):
    """A third of all turns in one conversation, over several ranges and strides."""
    monkeypatch.setattr(prefix_trie, "STRIDE", 5)
    monkeypatch.setattr(prefix_trie, "_SEGMENT", 10)
    rows = talks(7, n=40, most=9) + [(5, t, "user", f"t{t} é 0") for t in range(20, 300)] + [(6, t, "user", f"t{t} é 0") for t in range(20, 200)]
    got = prefix_trie.build_trie(conversations(spark, rows).repartition(7))
    assert Counter(tuple(r) for r in got.collect()) == trie(rows)


def test_repeated_turns_and_empty_tables(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (10, 1, "user", "a"), (10, 1, "user", "a"), (20, 3, "user", "a")]
    assert Counter(tuple(r) for r in prefix_trie.build_trie(conversations(spark, rows)).collect()) == trie(rows)
    assert prefix_trie.build_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.build_trie(conversations(spark, [(None, 1, "user", "a")])).count() == 0
