"""Operators over documents against brute force, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import decontamination, fingerprints, language_id, license_scan, mixing, near_dedup, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, place string, hashes string, block string, words int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def table(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (10 - len(r)))) for r in rows], SCHEMA)


def texts(seed=1, n=40):
    """Random texts with exact copies, edits, shared passages, blanks of all kinds, and a long one."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Émile", "straße", "x-y,", "THE", "Under"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    shared = " ".join(rng.choices(words, k=30))
    for i in range(0, n, 5):
        made[i] += "\t\n" + shared + "\x0b" + rng.choice(words)
    for i in range(1, n, 6):
        own = made[i].split(" ")
        own[len(own) // 2] = "edited"
        made.append(" ".join(own))
    made += made[:4] + ["", " \n ", "one", "two words", " ".join(rng.choices(words, k=3000)), "a b c d e " * 30]
    return made


@pytest.fixture(scope="module")
def rows():
    made = [(i * 3 % 101 if i < 30 else 200 + i, t) for i, t in enumerate(texts())]
    made += [made[2], (None, made[1][1]), (None, None), (900, None), (901, made[0][1])]
    return [(i, t, "en", None if k % 4 == 0 else f"s{k % 4}") for k, (i, t) in enumerate(made)]


def collected(df, key=("doc_id", "text")):
    return df.collect()


def test_near_duplicates_match_brute_force(spark, rows):
    sets = []
    for doc_id, text, *_ in rows:
        words = SPACED.findall(lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    expected = Counter()
    for i, (doc_id, *_) in enumerate(rows):
        component = least.get(find(i)) if sets[i] else doc_id
        expected[doc_id, len(sets[i]), component, doc_id == component] += 1
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


def test_large_mixed_buckets_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    made = []
    for i in range(40):  # a chain: far ends are unlike, neighbours alike
        own = list(base)
        for j in range(i):
            own[(j * 7) % 60] = f"x{j % 40}_{i // 2 if rng.random() < 0.2 else 0}"
        made.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(table(spark, made)).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in made}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[i] > root[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i], changed = root[j], True
    assert {r.doc_id: r.component_id for r in got} == root
    twice = [*made, *((i, t.replace("b5", "other")) for i, t in made[:30]), (3, "x y z"), (3, None)]
    assert near_dedup.near_duplicates(table(spark, twice)).count() == len(twice)


def test_links_just_above_the_threshold_are_found(spark):
    rng = random.Random(12)
    made, pairs = [], 0
    for i in range(1500):  # pairs of 100 words whose sets share 75 to 80 % of their union
        own = [f"p{i}_{k}" for k in range(104)]
        other = own[:87] + [f"o{i}_{k}" for k in range(rng.choice((6, 10)))]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (own, other))
        likeness = len(a & b) / len(a | b)
        pairs += 0.75 <= likeness
        assert 0.72 < likeness < 0.8
        made += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    got = near_dedup.near_duplicates(table(spark, made))
    assert got.where("doc_id % 2 = 1 AND component_id = doc_id - 1").count() == pairs


def test_sketches_estimate_jaccard_and_fill():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 2, 10, 500):
        one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        assert len(near_dedup.sketch(one)) == near_dedup.COORDINATES and near_dedup.sketch(one).all()
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - true) < 0.12


def test_repeats_match_brute_force(spark, rows):
    order = sorted({(2**63 if i is None else i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0], r[1]))
    order = [(i, t) for k, (i, t) in enumerate(order) if k == 0 or order[k - 1][0] != i or i == 2**63]
    seen, gone = set(), {}
    for i, t in order:
        words = SPACED.findall(t)
        lost = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                lost |= set(range(k, k + 20))
            seen.add(window)
        gone[i, t] = (len(words), len(lost), " ".join(w for k, w in enumerate(words) if k not in lost))
    got = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for i, t, *_ in rows:
        n, lost, kept = gone.get((2**63 if i is None else i, t), (0, 0, ""))
        expected[i, n, lost, hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    new = substring_dedup.without_repeats(table(spark, rows))
    assert new.columns == table(spark, rows).columns
    assert sorted(len(SPACED.findall(r.text or "")) for r in new.collect()) == sorted(r.n_words - r.n_removed for r in got)


def test_sketch_estimates_never_fall_below_true_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    chunks = [rng.integers(0, 3000, 2000) for _ in range(5)]
    true = Counter(np.concatenate(chunks).tolist())
    for bits in (8, 12, 24):  # more anchors than counters, about as many, and two blocks of counters at least
        pieces = {}
        for chunk in chunks:
            for row, block, cells, times in substring_dedup.sketch_pieces(chunk, bits):
                assert (np.diff(cells) > 0).all()
                pieces.setdefault((row, block), []).append((cells, times))
        totals = {at: substring_dedup.merged(own, 1 << min(bits, substring_dedup.BLOCK_BITS)) for at, own in pieces.items()}
        for anchor, n in true.items():
            places = [(row, int(substring_dedup.cells_of(np.array([anchor]), row, bits)[0])) for row in range(substring_dedup.ROWS)]
            estimate = min(totals[row, at >> substring_dedup.BLOCK_BITS][at & ((1 << substring_dedup.BLOCK_BITS) - 1)] for row, at in places)
            assert estimate >= n and (bits < 24 or estimate == n)
    assert sum(t.sum() for (row, _), t in totals.items() if row == 0) == 10_000


def test_repeats_are_the_same_where_copies_are_spread(spark, rows, monkeypatch):
    many = rows + [(3000 + i, *rows[0][1:]) for i in range(30)]
    plain = Counter(map(tuple, substring_dedup.remove_repeats(table(spark, many)).collect()))
    monkeypatch.setattr("meterlake.llm.common.HOT_ROWS", 2)
    assert Counter(map(tuple, substring_dedup.remove_repeats(table(spark, many)).collect())) == plain


def test_contamination_matches_brute_force_in_one_block_and_in_many(spark, rows):
    items = [(1, " ".join(SPACED.findall(rows[0][1])[:15])), (2, "Two WORDS"), (3, ""), (4, None), (5, "one"), (6, "w1 w2, w3"), (7, rows[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        words = PLAIN.findall(lower(t))
        k = min(10, len(words))
        for j in range(len(words) - k + 1 if k else 0):
            windows.setdefault(tuple(words[j : j + k]), set()).add(str(i))
    expected = Counter()
    for doc_id, t, *_ in rows:
        words, hit, met = PLAIN.findall(lower(t)), set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if owners := windows.get(tuple(words[j : j + k])):
                    hit |= set(range(j, j + k))
                    met |= owners
        expected[doc_id, len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)] += 1
    for most in (10_000, 70, 7):  # one block, parts of items, and blocks of them
        got = decontamination.find_contamination(table(spark, rows), benchmark, most).collect()
        assert Counter(tuple(r) for r in got) == expected
        left = decontamination.drop_contaminated(table(spark, rows), benchmark, most)
        assert left.columns == table(spark, rows).columns and left.count() == sum(n for r, n in expected.items() if not r[-1])
    assert not decontamination.find_contamination(table(spark, rows), benchmark.limit(0)).where("contaminated").count()


def test_mix_takes_some_of_equal_rows(spark):
    hot = [(7, "ten words of one row that stands here very often", None, "a")] * 900
    rest = [(1000 + i, f"w{i} " * 10, None, "a") for i in range(100)] + [(5000 + i, f"v{i} " * 10, None, "b") for i in range(1000)]
    docs = table(spark, hot + rest)
    got = mixing.mix_sources(docs)
    taken = {r.target: r.words for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("words")).collect()}
    assert len(taken) == 2 and all(abs(words - target) <= 10 for target, words in taken.items()), taken
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    unlike = table(spark, [(*r[:2], f"l{k % 3}", r[3]) for k, r in enumerate(hot + rest)])
    runs = [sorted(map(tuple, mixing.mixed_documents(x).collect()), key=repr) for x in (unlike, unlike.repartition(5))]
    assert runs[0] == runs[1] and sum(len(SPACED.findall(r[1])) * r[-1] for r in runs[0]) == sum(r.taken for r in got.collect())


def test_mix_comes_near_its_targets(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect()), key=repr)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(SPACED.findall(t or ""))) for i, t, *_ in rows)
    sources, total, largest = {}, sum(r.size for r in got), {}
    for (i, t, _, s) in rows:
        sources[s] = sources.get(s, 0) + len(SPACED.findall(t or ""))
        largest[s] = max(largest.get(s, 0), len(SPACED.findall(t or "")))
    by_size = {n: s for s, n in sources.items()}
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight, cap, target, open_ = {s: 1 + k % 3 for k, s in enumerate(order)}, {s: 3 * n for s, n in sources.items()}, {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        target |= {s: cap[s] for s in over} if over else share
        open_ -= set(over) if over else open_
    for size, s in by_size.items():
        mine = [r for r in got if r.source_size == size]
        assert all(abs(r.target - target[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest[s]
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "mix_times"]
    assert kept.agg(F.sum(F.col("mix_times") * F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] == sum(r.taken for r in got)


def license_by_hand(text, base, templates):
    """What a scan gives for one text, diagonal by diagonal."""
    words = PLAIN.findall(lower(text))
    run, places, base_labels, labels, score = license_scan.RUN, [], set(), set(), 0.0
    at = {}
    for p in range(len(words) - run + 1):
        at.setdefault(tuple(words[p : p + run]), []).append(p)
    for phrase, label, is_base in [(*t, True) for t in base] + [(*t, False) for t in templates]:
        own = PLAIN.findall(lower(phrase))
        runs, diagonals = len(own) - run + 1, {}
        for t in range(runs):
            for p in at.get(tuple(own[t : t + run]), []):
                diagonals.setdefault(p - t, set()).add(t)
        bands = []
        for d in sorted(diagonals):
            bands.append([d]) if not bands or d - bands[-1][-1] > license_scan.DRIFT else bands[-1].append(d)
        for band in bands:
            spans, last = [], None
            for d in sorted(band, key=lambda d: (d + min(diagonals[d]), d)):
                begin, end = d + min(diagonals[d]), d + max(diagonals[d])
                spans.append([d]) if last is None or begin > last + license_scan.REACH else spans[-1].append(d)
                last = end if last is None else max(last, end)
            for span in spans:
                found = len(set().union(*(diagonals[d] for d in span)))
                whole = [d for d in span if len(diagonals[d]) == runs]
                if is_base and whole:
                    places += whole
                    base_labels.add(label)
                if whole if runs <= license_scan.SHORT or is_base else found / runs >= license_scan.COVER:
                    labels.add(label)
                score = max(score, found / runs if runs > license_scan.SHORT or whole else found / runs / 2)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(score, 9)


def test_licenses_match_brute_force(spark):
    rng = random.Random(11)
    whole = {label: text for text, label in license_scan.TEXTS}
    edited = whole["bsd-3"].split()
    for k in range(15, len(edited), 15):  # words put in, left out and changed
        edited[k] = rng.choice(["", "really very " + edited[k], "other"])
    docs = [
        (1, "Released under the MIT License. Also under the MIT license, CC-BY-NC 4.0 and cc by nc"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "the mit license under"), (4, ""), (5, None), (None, "CC BY NC " * 2000), (7, "x"),
        (8, "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"),
        (1, "under the mit license"), (1, "under the mit license"), (None, None), (None, None),
        (9, "Some words before. " + whole["bsd-3"] + " and after"), (10, " ".join(edited)), (11, whole["mit"] + whole["mit"] + whole["zlib"]),
        (12, " ".join(whole["unlicense"].split()[:60])), (13, "all rights reserved " + whole["agpl"].upper()),
    ]
    long = " ".join(f"t{i % 97}x{i}" for i in range(400))
    repeating = " ".join(f"r{i % 7}" for i in range(90))
    docs += [(20, f"a b {long} c"), (21, " ".join(w for w in long.split() if rng.random() > 0.05)), (22, f"{long} x {long}"), (23, repeating), (24, long[: len(long) // 2])]
    base = (*license_scan.BASE, (long, "long"))
    templates = (*license_scan.TEXTS, (long + " tail end", "longer"), (repeating, "repeating"), ("a", "never"))
    got = license_scan.scan_licenses(table(spark, docs), base, templates).collect()
    expected = Counter((i, *license_by_hand(t, base, templates)) for i, t in docs)
    assert Counter((*tuple(r)[:-1], round(r.score, 9)) for r in got) == expected
    labels = {r.doc_id: set(r.labels.split(",")) for r in got}
    assert "mit" in labels[8] and "bsd-3" in labels[9] & labels[10] and {"mit", "zlib"} <= labels[11] and "agpl" in labels[13] and {"long", "longer"} <= labels[20]
    plain = license_scan.scan_licenses(table(spark, docs))
    assert {r.score for r in plain.where("doc_id = 9").collect()} == {1.0}
    assert not license_scan.scan_licenses(table(spark, [])).count()


def test_fingerprints_follow_the_edited_text(spark, rows):
    got = fingerprints.fingerprint_edits(table(spark, rows)).collect()
    assert len(got) == len(rows)
    ids = [r for r in rows if r[0] is not None]
    order = sorted({i for i, *_ in ids}, reverse=True)
    first_of = {i: {t or "" for j, t, *_ in ids if j == i} for i in order}
    for r in got:
        own = [t or "" for i, t, *_ in rows if i == r.doc_id and len(t or "") == r.n_chars]
        assert own and len(r.fingerprint) == 8 * fingerprints.SUBSETS == len(r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in order[:-1] and sum(i == r.doc_id for i, *_ in rows) == 1:
            half = r.n_chars // 2
            nexts = first_of[order[order.index(r.doc_id) + 1]]
            digests = {hashlib.sha256((own[0][: r.n_chars - half] + n[:half]).encode()).hexdigest() for n in nexts}
            assert r.edited_sha256 in digests
    by_text = {}
    for r in got:
        for i, t, *_ in rows:
            if i == r.doc_id and len(t or "") == r.n_chars:
                by_text.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for t, x in by_text.items() if sum(len(t) == len(u or "") for _, u, *_ in rows) == 1)
    assert not fingerprints.fingerprint_edits(table(spark, [])).count()
    one = fingerprints.fingerprint_edits(table(spark, [(1, "abc def")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and one.near_next == 1


def xx(value, seed=42):
    """Spark's xxhash64 of a text, of a number, or of several in turn, as a signed number."""
    for x in value if isinstance(value, (list, tuple)) else [value]:
        seed = xxhash.xxh64(x.encode() if isinstance(x, str) else struct.pack("<q", x), seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def fingerprints_by_hand(texts):
    """The I-Match hashes of a text, as a function, after learning the lexicon of ``texts``."""
    top = lambda h, bits: (h % 2**64) >> (64 - bits)
    words = lambda t: [xx(w) for w in PLAIN.findall(t.lower())]
    sketches = {}
    for t in set(texts):
        own, keys = words(t), []
        shingles = [xx(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
        for band in range(fingerprints.BANDS):
            rows = {}
            for h in shingles:
                if top(h, 3) == band:
                    rows[top(h, 5)] = min(rows.get(top(h, 5), h), h)
            if rows:
                keys.append(xx(sorted(rows.values())))
        if own:
            sketches[xx(t)] = (set(own), keys or [xx(t)])
    heads = {}
    for own, (_, keys) in sketches.items():
        for key in keys:
            heads[key] = min(heads.get(key, own), own)
    counted = [terms for own, (terms, keys) in sketches.items() if all(heads[k] == own for k in keys)]
    df = Counter(t for terms in counted for t in terms)
    most = max(fingerprints.LEAST_DOCS, fingerprints.COMMONEST * len(counted))
    least = max(fingerprints.LEAST_DOCS, fingerprints.RAREST * len(counted))

    def hashes(text):
        every = set(words(text))
        if not every:
            return [xx(text) >> 32] * fingerprints.SUBSETS
        band = {t for t in every if least <= df[t] <= most}
        filled = [*band, *sorted(t for t in every - band if df[t] <= most), *sorted(t for t in every - band if df[t] > most)]
        own = sorted(band if len(band) >= fingerprints.LEAST_TERMS else filled[: fingerprints.LEAST_TERMS])
        out = []
        for i, rate in enumerate(fingerprints.RATES):
            bits = [(h % 2**64) >> sum(fingerprints.RATES[:i]) & ((1 << rate) - 1) for h in own]
            for j in range(fingerprints.REPEATS):
                part = [h for h, b in zip(own, bits, strict=True) if b == j << (rate - 3)]
                out.append(xx(part) >> 32 if part else None)
        return out

    return hashes


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(600)] + ["Straße", "été"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 150))) for _ in range(90)] + ["", "  ", "--", "the one", "x " * 3000]
    made += [made[0].replace("w1", "v1"), made[0], made[5]] + [" ".join([*made[7].split(), f"end{i}"]) for i in range(30)]
    docs = [(5 * i, t) for i, t in enumerate(made)]
    by_hand = fingerprints_by_hand([t for _, t in docs])
    shown = lambda hashes: "".join("-" * 8 if h is None else f"{h & 0xFFFFFFFF:08x}" for h in hashes)

    def like(a, b):
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return round(sum(x == y for x, y in pairs) / len(pairs), 9)

    order = sorted(docs, reverse=True)
    expected = set()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, its, new = by_hand(t), by_hand(after), by_hand(edited)
        expected.add((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(new), like(own, new), like(own, its)))
    got = fingerprints.fingerprint_edits(table(spark, docs)).collect()
    assert {(*tuple(r)[:-2], round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == expected and len(got) == len(docs)


@pytest.mark.parametrize("own_words", [False, True])
def test_large_groups_of_near_copies_keep_like_fingerprints(spark, own_words):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    others = [(i, " ".join(rng.choices(words, k=120))) for i in range(120)]
    base = [f"own{i}" for i in range(120)] if own_words else rng.choices(words, k=120)
    copies = []
    for i in range(60):  # a third of the rows
        copy = list(base)
        copy[rng.randrange(120)] = rng.choice(words)
        copies.append((1000 + i, " ".join(copy)))
    got = fingerprints.fingerprint_edits(table(spark, others + copies + copies[:5])).collect()
    group = [r for r in got if r.doc_id > 1000]  # the next document of the last copy is another text
    assert sum(r.near_next > 0.5 for r in group) >= 0.95 * len(group) and all(r.near_next > 0 for r in group)
    assert all(r.near_edited > 0 for r in group)  # half of the text is replaced
    alone = [r for r in got if r.doc_id < 120]
    assert sum(r.near_edited > r.near_next for r in alone) > 0.9 * len(alone)


def test_near_copies_of_any_length_share_bands(spark):
    """A text and its edits by one word, added or replaced, at lengths from 100 to 300."""
    rng = random.Random(9)
    made = []
    for n in [*range(100, 301, 10), 127, 128, 129, 255, 256, 257]:
        own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        made += [" ".join(own), " ".join([*own, "added"]), " ".join([*own[: n // 2], "edited", *own[n // 2 + 1 :]])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, text string")
    keys = [set(r.keys) for r in rows.select("i", fingerprints._buckets(fingerprints._words(F.col("text"))).alias("keys")).orderBy("i").collect()]
    shared = [len(keys[i] & keys[i + k]) for i in range(0, len(keys), 3) for k in (1, 2)]
    assert min(shared) >= 3 and sum(shared) / len(shared) > 6
    heads = fingerprints.differing(fingerprints.Scratch(spark, "test"), rows.select("text")).count()
    assert heads <= len(made) / 3 * 1.1


def test_groups_of_near_copies_are_counted_about_once(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    made = [(i, " ".join(rng.choices([f"w{i}" for i in range(4000)], k=100))) for i in range(50)]
    made += made[:3] + [(60, ""), (61, None), (62, "one two"), (63, "one two")]
    edits = [list(base) for _ in range(100)]
    for k, copy in enumerate(edits):
        copy[k * 2 % 200] = f"edit{k}"
    made += [(100 + k, " ".join(copy)) for k, copy in enumerate(edits)]
    scratch = fingerprints.Scratch(spark, "test")
    assert 52 <= fingerprints.differing(scratch, table(spark, made).select("text")).count() <= 54
    assert not fingerprints.differing(scratch, table(spark, []).select("text")).count()


def test_toxicity_ranks_held_out_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        own = rng.choices(words, k=60)
        if i % 6 == 0:
            own[5], own[30] = rng.choice(["vile", "scum"]), "rot" + rng.choice(words)
        docs.append((i, " ".join(own)))
        if i % 2 == 0:
            labels.append((i, None, int(i % 6 == 0)))
    docs += [(None, None), (9000, ""), (9001, "vile scum"), (9001, "vile scum")]
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    table_ = table(spark, docs)
    model = toxicity.train(table_, labels)
    got = toxicity.score_toxicity(table_, model).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum((r.predicted == 1) == (r.doc_id % 6 == 0) for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got) and len(got) == len(docs)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    left = toxicity.drop_toxic(table_, model)
    assert left.columns == table_.columns and left.count() == sum(r.predicted == 0 for r in got)
    none = toxicity.score_toxicity(table_, toxicity.train(table_, labels.limit(0))).collect()
    assert all(r.score < 0.01 for r in none)


@pytest.mark.parametrize("n", [2000, 2001, 2500])
def test_a_language_of_rows_under_one_id_is_learned(spark, n):
    for doc_id in (i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2):
        rows = [(doc_id, f"le texte numéro {i} est écrit en français" if doc_id % 2 else "toujours la même chose", "fr") for i in range(n)]
        rows += [(i, "the text is written in English", "en") for i in range(30)]
        docs = table(spark, rows)
        profiles = language_id.learn_profiles(docs)
        assert set(profiles) == {"en", "fr"} and len(profiles["fr"]) > 10
        if doc_id >= 4:
            break


def test_toxicity_samples_are_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 20)
    monkeypatch.setattr(toxicity, "MAX_POSITIVES", 15)
    sizes = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda words, positives, unlabelled, prior: sizes.append((len(positives), len(unlabelled))) or fit(words, positives, unlabelled, prior))
    ids = [r.doc_id for r in spark.range(200).select(F.col("id").alias("doc_id")).where(toxicity.fold(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id")).collect()]
    labels = spark.createDataFrame([(i, None, 1) for i in ids[:10]], "doc_id long, quality int, toxic int")
    once = [(i, f"text w{i} vile") for i in ids]
    for more, expected in (
        ([], (10, 20)),
        ([once[0]] * 50, (10, 20)),  # one text many times over
        ([(ids[0], f"other x{k}") for k in range(50)], (15, 20)),  # many texts of one id
    ):
        toxicity.train(table(spark, once + more), labels)
        assert sizes.pop() == expected


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, language_id.learn_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    odd = table(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "the and of the that with"), (5, "ß" * 200_000)])
    found = {r.doc_id: r for r in language_id.identify(odd, language_id.learn_profiles(docs)).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[None].lang_pred == "en" and 0 <= found[5].score <= 1
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_languages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = language_id.learn_profiles(docs)

    def plain_grams(text):
        line = " ".join("".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split(" "))
        line = re.sub(" +", " ", line)
        out = Counter(c for c in line if c != " ")
        out.update(line[i : i + 2] for i in range(len(line) - 1))
        out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
        return out

    def number(gram):
        n = 0
        for c in gram:
            n = n << 21 | (1 if c == " " else ord(c))
        return n

    def plain_ranking(counts):
        return [number(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][: language_id.TOP]

    every = docs.collect()
    held = {r.doc_id for r in docs.where(language_id.fold(F.col("doc_id")) == 2).select("doc_id").collect()}
    totals = {}
    for r in every:
        if r.doc_id not in held and r.lang is not None and r.text is not None:
            totals.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    by_hand = {lang: plain_ranking(counts) for lang, counts in sorted(totals.items())}
    assert {lang: p.tolist() for lang, p in profiles.items()} == by_hand  # fewer documents than a sample takes
    places = {lang: {g: i for i, g in enumerate(p)} for lang, p in by_hand.items()}
    got = {r.doc_id: r for r in language_id.identify(docs, profiles).collect()}
    for r in every:
        if r.text and any(c.isalpha() for c in r.text):
            own = plain_ranking(plain_grams(r.text))
            far = {lang: sum(abs(p[g] - i) if g in p else language_id.TOP for i, g in enumerate(own)) for lang, p in places.items()}
            one, two = sorted(far.values())[:2]
            assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 9)) == (min(far, key=lambda x: (far[x], x)), round(two / (one + two), 9))


def test_risk_gradients_and_scores_match_plain_python(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = np.sort(rng.choice(10_000, 6, replace=False)).astype(np.int64)
    sets = [np.sort(rng.choice(words, rng.integers(0, 5), replace=False)) for _ in range(40)]
    positives, unlabelled, prior = sets[:12], sets[12:], 0.3

    def risk(theta, bias):
        g = lambda own: bias + sum(theta[list(words).index(w)] for w in own)
        soft = lambda x: np.logaddexp(0, x)
        toxic = np.mean([soft(-g(s)) for s in positives])
        negative = np.mean([soft(g(s)) for s in unlabelled]) - prior * np.mean([soft(g(s)) for s in positives])
        return prior * toxic, negative, 0.5 * toxicity._DECAY * float(theta @ theta)

    seen = []
    fit_sigmoid = toxicity._sigmoid
    monkeypatch.setattr(toxicity, "_sigmoid", lambda x: seen.append(x.copy()) or fit_sigmoid(x))
    monkeypatch.setattr(toxicity, "_EPOCHS", 1)
    one = toxicity.fit(words, positives, unlabelled, prior)
    theta, bias, step = np.zeros(len(words)), float(np.log(prior / (1 - prior))), 1e-6
    whole = lambda t, b: sum(risk(t, b)) if risk(t, b)[1] >= 0 else -risk(t, b)[1] + risk(t, b)[2]
    slopes = [(whole(theta + step * e, bias) - whole(theta - step * e, bias)) / (2 * step) for e in np.eye(len(words))]
    slopes.append((whole(theta, bias + step) - whole(theta, bias - step)) / (2 * step))
    moved = np.append(one.weights, one.bias - bias)
    # Adam's first step moves every weight by its rate against the sign of its slope
    sure = np.abs(slopes) > 1e-5
    assert np.allclose(moved[sure], -toxicity._RATE * np.sign(np.array(slopes)[sure]), atol=1e-3)

    monkeypatch.undo()
    texts = ["vile words viler vilest", "plain", "", None, "vile " * 3000]
    chunk = next(toxicity.tokens.words(pa.array(texts), toxicity.tokens.PLAIN))
    owner, feature = toxicity.features(chunk)
    some = np.unique(feature)[::2]
    model = toxicity.Model(some, np.linspace(-1, 1, len(some)), 0.1, 2.0, -0.3)
    by_hand = [1 / (1 + np.exp(-(2.0 * (0.1 + sum(model.weights[list(some).index(f)] for f in set(feature[owner == i].tolist()) & set(some.tolist()))) - 0.3))) for i in range(len(texts))]
    assert np.allclose(toxicity._Scorer(model)(pa.array(texts)), by_hand)


def test_empty_tables_give_empty_results(spark):
    none = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        near_dedup.near_duplicates(none), substring_dedup.remove_repeats(none), decontamination.find_contamination(none, bench), mixing.mix_sources(none),
        toxicity.score_toxicity(none, toxicity.train(none, labels)), language_id.identify(none, language_id.learn_profiles(none)),
    ):
        assert df.count() == 0
