"""The pipeline's stages against brute force on made documents, and the whole pipeline on the given ones."""

import random
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from meterlake.llm import decontamination, near_dedup, queries, toxicity
from meterlake.llm.common import table

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Further columns have names that the operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _copy int, _own string, _id int, _gone string, _twice boolean, _mix_source int, _mix_plan string, "
    "_repeats_place int, place int, text_a string, marks string, copy int, row string, mix_hash string, size int, rounds string, threshold int, number int, _part int"
)
STAGES = dict(corpus_pipeline.STAGES)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def made(spark, rows):
    width = SCHEMA.count(",") + 1
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *[None] * (width - 5)) for i, t, s in rows], SCHEMA)


def documents():
    """Texts with near copies, repeats of rows, nulls, empties, shared passages and benchmark passages."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(40)]
    passage, question = " ".join(rng.choices(words, k=25)), " ".join(f"q{i}" for i in range(12))
    rows = [(i * 7 % 41, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(100 + i, t.replace(t.split()[3], "edit", 1), "s1") for i, t in enumerate(texts[:6])]
    rows += [(200 + i, f"{t} {passage}\n{texts[i]}x", "s2") for i, t in enumerate(reversed(texts[10:16]))]
    rows += [(300, f"alpha {question} omega", "s0"), (301, " ".join(question.split()[:9]), "s0"), (302, None, None), (303, "", "s1"), (304, " \n", None)]
    rows += [rows[1], rows[1], (None, None, None), (None, None, "s9"), (None, texts[5], "s1"), (None, "only without an id", "s1"), (None, "only without an id", "s1")]
    rows += [(1, "", "s0"), (305, "x " * 3000, "s2"), (306, "ß " * 2500 + "y", "s2"), (303, "", "s1")]
    return rows, [(1, question.upper()), (2, None), (3, "")]


def test_near_duplicates_leave_one_of_each_group(spark):
    rows, _ = documents()
    sets = []
    for _, t, _ in rows:
        w = SPACED.findall(lower(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            # rows without an id are near to rows of the same set alone
            alike = sets[i] == sets[j] if rows[i][0] is None or rows[j][0] is None else 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            if sets[i] and sets[j] and alike:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    expected = Counter()
    for g in set(group):
        own = [rows[i] for i in range(len(rows)) if group[i] == g]
        if any(t is not None and SPACED.search(t) for _, t, _ in own):
            named = [r for r in own if r[0] is not None]
            expected[min((r[0] for r in named), default=None)] += 1
    blank = {(i, t) for i, t, _ in rows if not SPACED.search(t or "")}
    expected += Counter(i for i, _ in blank)
    got = STAGES["near_duplicates"](spark, made(spark, rows), SF)
    assert got.columns == made(spark, rows).columns
    assert Counter(r.doc_id for r in got.collect()) == expected


def test_repeats_and_benchmark_passages_go(spark):
    rows, items = documents()
    seen, lost = set(), {}
    for i, t in sorted({(2**63 if i is None else i, t) for i, t, _ in rows if t}, key=lambda r: r[0]):
        w, gone = SPACED.findall(t), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone |= set(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        lost[i, t] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    docs = made(spark, rows)
    got = STAGES["repeated_passages"](spark, docs, SF)
    assert got.schema == docs.schema
    expected = Counter((i, s, new, None if new is None else len(new)) for i, t, s in rows for new in [lost.get((2**63 if i is None else i, t), t)])
    # texts that share the id null go by their hash, so only their ids and sources are compared
    strip = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None})
    found = Counter((r.doc_id, r.source, r.text, r.n_chars) for r in got.collect())
    assert strip(found) == strip(expected) and sum(found.values()) == len(rows)

    windows = {tuple(PLAIN.findall(lower(t))[k : k + 10]) for _, t in items if t for k in range(len(PLAIN.findall(lower(t))) - 9)}
    clean = Counter(i for i, t, _ in rows for w in [PLAIN.findall(lower(t))] if not any(tuple(w[k : k + 10]) in windows for k in range(len(w))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = decontamination.drop_contaminated(docs, benchmark)
    assert left.schema == docs.schema and Counter(r.doc_id for r in left.collect()) == clean and 300 not in clean


def test_the_mix_takes_what_it_says(spark):
    rows, _ = documents()
    docs = made(spark, rows)
    got = STAGES["mixing"](spark, docs, SF)
    assert got.columns == [*docs.columns, "mix_times"]
    size = lambda t: len(SPACED.findall(t or ""))
    per_source, largest = Counter(), Counter()
    for _, t, s in rows:
        per_source[s] += size(t)
        largest[s] = max(largest[s], size(t))
    order = sorted(per_source, key=lambda s: (s is None, s or ""))
    weight, target, free, total = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, set(order), sum(per_source.values())
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * per_source[s] for s in free if share[s] > 3 * per_source[s]}
        target |= over or share
        free -= set(over or share)
    taken, kept = Counter(), got.collect()
    for r in kept:
        taken[r.source] += r.mix_times * size(r.text)
        assert 1 <= r.mix_times <= 3 and size(r.text)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert STAGES["mixing"](spark, got, SF).columns == got.columns  # its own column is replaced


def test_stages_take_hostile_tables(spark):
    rows, _ = documents()
    docs = made(spark, rows)
    clean = STAGES["toxicity"](spark, docs, SF)
    assert clean.schema == docs.schema
    scores = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, SF, "labels")))
    assert clean.count() == scores.where("predicted = 0").count()
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns[: len(docs.columns)] == docs.columns, name
        nulls = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
        assert stage(spark, nulls, SF).count() == {"near_duplicates": 1, "mixing": 0}.get(name, len(rows)), name


def test_stages_apply_their_operators(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = STAGES["near_duplicates"](spark, docs, SF)
    assert ids(one) == ids(near_dedup.near_duplicates(docs).where("kept"))
    left = STAGES["decontamination"](spark, docs, SF)
    assert ids(left) == ids(decontamination.find_contamination(docs, table(spark, SF, "benchmark")).where("NOT contaminated"))


def test_pipeline_runs_through(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-1] == "mix_times" and out.count() > 50
    assert set(queries.ORACLES) <= set(queries.QUERIES)
