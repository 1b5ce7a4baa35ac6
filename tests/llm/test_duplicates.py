"""Line, string and near duplicates against brute force."""

import hashlib
import json
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sedimark.llm import decontaminate, jaccard, lines, registry, repeats
from sedimark.llm.graph import components
from tests.llm.conftest import BASE, PASSAGE, ROUGH, frame, ordered

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))


def brute_repeats(rows, in_order=ordered):
    seen, out = set(), []
    for doc_id, text in in_order(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            piece = raw[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((str(doc_id), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check_repeats(docs, rows):
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.repeats(docs).collect()) == brute_repeats(rows)


def test_repeats_on_documents(documents, rows_of):
    check_repeats(documents, rows_of)


def test_repeats_on_rough_rows(rough, nothing):
    check_repeats(rough, ROUGH)
    assert repeats.repeats(nothing).collect() == []


def test_repeats_at_every_offset(spark):
    """Copies of every length about the limit, at shifting places, and texts that repeat themselves."""
    draw = np.random.default_rng(5)
    source = "".join(map(chr, draw.integers(97, 123, 4000)))
    rows = [(0, source)] + [(i, "".join(map(chr, draw.integers(97, 123, i))) + source[7 * i : 7 * i + 95 + i % 12] + "?") for i in range(1, 60)]
    rows += [(100, "ab" * 400), (101, "x" * 99), (102, "x" * 100), (103, "x" * 101), (104, "é" * 80)]
    check_repeats(frame(spark, rows), rows)


def test_later_batches_meet_the_kept_index(spark, rows_of, tmp_path):
    """Batches in any order of ids: what comes later loses what an earlier batch has, byte by byte."""
    draw = np.random.default_rng(11)
    source = "".join(map(chr, draw.integers(97, 123, 3000)))
    # the same anchors in other surroundings, so that old segments have to be looked into
    planted = [(10_000 + i, "".join(map(chr, draw.integers(97, 123, 40))) + source[37 * i : 37 * i + 90 + 3 * i] + "!" * 30) for i in range(40)]
    rows = [*rows_of, *planted, (20_000, source)]
    order = draw.permutation(len(rows))
    batches = [[rows[i] for i in order[k::4]] for k in range(4)]
    index = repeats.RepeatIndex(spark, str(tmp_path / "index"), buckets=5)
    got = []
    for some in batches:
        kept = index.add(frame(spark, some, False)).collect()
        got += [(str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in kept]
    expected = brute_repeats(None, lambda _: [r for some in batches for r in ordered(some)])
    assert sorted(got) == expected
    lists = [json.loads(p.read_text()) for p in (tmp_path / "index/segments").glob("bucket-*/list-3.json")]
    assert len(lists) == 5 and all(len(x["levels"]) <= 12 for x in lists)


def test_a_batch_that_fails_can_be_added_again(spark, tmp_path, monkeypatch):
    rows = [[(1, "x" * 50 + BASE), (2, PASSAGE)], [(0, BASE + PASSAGE)]]
    index = repeats.RepeatIndex(spark, str(tmp_path / "index"), buckets=3)
    index.add(frame(spark, rows[0], False))
    with monkeypatch.context() as patch:
        patch.setattr(repeats, "_finish", None)
        with pytest.raises(Exception):
            index.add(frame(spark, rows[1], False))
    (one,) = index.add(frame(spark, rows[1], False)).collect()
    expected = brute_repeats(None, lambda _: [r for some in rows for r in ordered(some)])
    assert (str(one.doc_id), one.n_bytes, one.n_bytes - len(one.kept), len(one.spans), hashlib.sha256(one.kept).hexdigest()) == expected[0]


def traced(work):
    """What ``work`` returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def part_of(texts):
    """A dealt part, as its tasks get it."""
    return pa.table({"part": pa.array([0] * len(texts), pa.int32()), "doc_id": list(range(len(texts))), "turn": [0] * len(texts), "text": texts})


def test_memory_of_what_stays_follows_the_text():
    """Spans at both ends of documents, side by side over their borders and beside empty ones."""
    texts = [t for k in range(100) for t in ("".join(map(chr, np.random.default_rng(k).integers(32, 127, 20_000))), "")]
    row = np.repeat(np.arange(0, 200, 2), 3)
    spans = {"row": row, "start": np.tile([0, 7_000, 19_900], 100), "length": np.tile([100, 150, 100], 100)}
    answers = pa.table({"part": [0], "kind": [repeats.REMOVED], "payload": [repeats.pack(spans, repeats.SPAN)]})
    out, most = traced(lambda: repeats._finish(part_of(texts), answers))
    assert out.column("kept").to_pylist() == [(t[100:7_000] + t[7_150:19_900]).encode() for t in texts]
    assert [[(x["start"], x["end"]) for x in some] for some in out.column("spans").to_pylist()] == [[(0, 100), (7_000, 7_150), (19_900, 20_000)] if t else [] for t in texts]
    assert most < 5 * sum(map(len, texts))  # 26 times, when each byte had integers of eight


def test_memory_of_single_windows_follows_them():
    """A part whose every window is asked for, and has a copy in the part."""
    half = ["".join(map(chr, np.random.default_rng(k).integers(32, 127, 20_035))) for k in range(30)]
    start = np.arange(0, 20_035 - 99, 64)
    wanted = {"row": np.repeat(np.arange(60), len(start)), "start": np.tile(start, 60), "more": np.tile(np.minimum(63, 20_035 - 100 - start), 60)}
    answers = pa.table({"part": [0], "kind": [repeats.WINDOWS], "payload": [repeats.pack(wanted, repeats.ASKED)]})
    out, most = traced(lambda: repeats._ask_windows(7)(part_of(half * 2), answers))
    sent = [repeats.unpack(x.as_buffer(), repeats.ENTRY) for x in out.filter(pc.equal(out.column("kind"), repeats.SEGMENT)).column("payload")]
    assert sorted((r, s) for x in sent for r, s in zip(x["row"].tolist(), x["start"].tolist())) == [(r, s) for r in range(30) for s in range(20_035 - 99)]
    removed = repeats.payloads(out, repeats.REMOVED, repeats.SPAN)
    assert [tuple(x) for x in zip(*(removed[c].tolist() for c in repeats.SPAN))] == [(r, 0, 20_035) for r in range(30, 60)]
    assert most < 100 * 60 * (20_035 - 99)


def test_the_level_family_keeps_few_levels():
    family = repeats.LevelFamily()
    draw = np.random.default_rng(1)
    for i in range(200):
        keys = np.unique(draw.integers(0, 1 << 60, 50)).astype("u8")
        n = len(keys)
        family.insert({"key": keys, "check": np.zeros(n, "u4"), "doc": np.full(n, i), "row": np.zeros(n, "u4"), "start": np.zeros(n, "u4"), "more": np.zeros(n, "u1"), "epoch": np.zeros(n, "u4"), "part": np.zeros(n, "i4")})
    assert len(family.levels) <= 10
    assert all((np.diff(level["key"].astype("f8")) >= 0).all() for level in family.levels)


def brute_jaccard(rows):
    rows = list(rows)
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    both = Counter((a, b) for found in held.values() for n, b in enumerate(found) for a in found[:n])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            top[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check_jaccard(docs, rows):
    got = jaccard.jaccard_report(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows)


def test_jaccard_on_rough_rows(rough, nothing):
    check_jaccard(rough, ROUGH)
    assert jaccard.jaccard_report(nothing).collect() == []


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_in_a_polynomial_stay_apart(spark):
    """Complementary Thue-Morse words are alike to any polynomial modulo 2**64; they are different words."""
    one, other = thue_morse(1 << 11, "ab"), thue_morse(1 << 11, "ba")
    rows = [(1, one + " x y z w"), (2, other + " x y z w"), (3, one + " x y z w")]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_report(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(9, other + " x y z w")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.matches(frame(spark, rows), items).collect()] == [2]
    check_repeats(frame(spark, [(1, one), (2, other)]), [(1, one), (2, other)])


def test_a_leader_with_very_many_pairs(spark):
    """A third of all documents are copies with an edit each: one component, without pairs among the copies."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 110], f"edit{i}", *base[i % 110 + 1 :]])) for i in range(300)] + [(1000 + i, f"other {i} " + " ".join(f"o{i}x{j}" for j in range(30))) for i in range(600)]
    check_jaccard(frame(spark, rows, False), rows)


def test_jaccard_on_a_chain_of_edits(spark):
    """Neighbours in the chain are links, its ends aren't; a star about any one node misses some."""
    text, rows = [f"w{i}" for i in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[7 * i % 300] = f"e{i}"
        text[(7 * i + 151) % 300] = f"f{i}"
    rows += [(100 + i, " ".join([f"w{j}" for j in range(300)][: 300 - 12 * i])) for i in range(10)]
    check_jaccard(frame(spark, rows), rows)


def test_jaccard_at_the_very_limit(spark):
    """100 * intersection = 80 * union is a link, one shingle less is not."""
    rows = [(1, " ".join(f"a{i}" for i in range(84))), (2, " ".join(f"a{i}" for i in range(104))), (3, " ".join(f"b{i}" for i in range(83))), (4, " ".join(f"b{i}" for i in range(104)))]
    check_jaccard(frame(spark, rows), rows)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_report(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_of_each_group_stays(rough):
    clash = rough.withColumn("__print", F.col("doc_id")).withColumn("row", F.lit("r")).withColumn("stays", F.lit(False))
    kept = jaccard.keep_one(clash)
    assert kept.columns == clash.columns
    kept = kept.collect()
    found = [(r.doc_id, r.text) for r in kept]
    assert all(r["__print"] == r.doc_id and r.row == "r" for r in kept)
    assert sum(t in (BASE, BASE.replace("base7 ", "edit ")) for _, t in found) == 1 and (9, BASE) in found
    assert {t for d, t in found if d == 15} == {"same id, first text", "same id, second text"}
    assert {(1, None), (2, ""), (None, None), (4, "one two three")} <= set(found) and (5, "One TWO three") not in found


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (60, 60)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50}
    assert components(links.limit(0)).collect() == []


def brute_lines(rows, least_bytes=None):
    """Any run of lines that counts (a non-blank line, or so many bytes) and also starts earlier loses its lines."""
    documents = sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}

    def runs(text):
        found = text.split("\n")
        for i in range(len(found)):
            size = 0
            for j in range(i, len(found)):
                size += bool(found[j].strip(" \t\r\f\x0b")) if least_bytes is None else len(found[j].encode())
                if size >= (least_bytes or 1):
                    yield i, j, "\n".join(found[i : j + 1])

    for d, t in documents:
        for i, _, run in runs(t):
            first.setdefault(run, (d, t, i))
    for d, t in documents:
        gone = set()
        for i, j, run in runs(t):
            if first[run] != (d, t, i):
                gone |= set(range(i, j + 1))
        found = t.split("\n")
        out[d, t] = (len(found), len(gone), "\n".join(x for k, x in enumerate(found) if k not in gone))
    return out


@pytest.mark.parametrize("least", [None, 100])
def test_lines_on_rough_rows(rough, nothing, least):
    rows = [r for r in ROUGH if r[0] != 15]  # two texts of one id are ordered by their hash
    expected = brute_lines(rows, least)
    clash = rough.withColumn("doc", F.lit(77)).withColumn("gone", F.col("text")).withColumn("row", F.lit("r"))
    got = lines.dedup_lines(clash.where("doc_id is null or doc_id <> 15"), least)
    assert [c for c in got.columns if c not in ("n_lines", "n_deleted")] == [c for c in clash.columns if c != "n_lines"]
    found = got.collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_deleted, r.text or "") for r in found) == sorted((str(d), *expected.get((d, t), (0, 0, ""))) for d, t in rows)
    assert {r.doc for r in found} == {77} and {r.row for r in found} == {"r"} and {r.print for r in found} == {3}
    assert lines.line_report(nothing, least).collect() == []


def test_lines_of_long_runs(spark):
    text = "\n".join(f"short {i}" for i in range(70))
    rows = [(1, text), (2, "own\n" + text), (3, "\n".join(text.split("\n")[5:40]) + "\nown"), (4, "short 1\nshort 2"), (5, text + "\n" + text)]
    expected = brute_lines(rows, 100)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(frame(spark, rows, False), 100).collect()}
    assert got == {d: expected[d, t] for d, t in rows}
    assert got[2][2] == "own" and got[4][1] == 0 and got[5][2] == ""


def test_runs_at_every_depth(spark):
    """Least runs of 1 to 40 lines: doubling goes as deep as the longest of them, and no deeper run is lost."""
    draw = np.random.default_rng(8)
    source = ["" if draw.random() < 0.9 else f"l{draw.integers(6)}" for _ in range(400)]
    rows = [(i, "\n".join(source[(a := int(draw.integers(300))) : a + int(draw.integers(5, 100))])) for i in range(25)]
    for least in (None, 7, 30):
        expected = brute_lines(rows, least)
        got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(frame(spark, rows, False), least).collect()}
        assert got == {d: expected[d, t] for d, t in rows}, least


def test_every_run_of_lines(spark):
    """Short lines that recur alone go, blank lines only beside them, and the first copy stays."""
    rows = [(1, "(c) short\nown 1"), (2, "own 2\n(c) short"), (3, "\n\nown 3\n"), (4, "own 4\n \t\n(c) short\n(c) short"), (5, "x\n\ny"), (6, "x\n\nz"), (7, None)]
    got = {r.doc_id: (r.n_deleted, r.text) for r in lines.dedup_lines(frame(spark, rows, False)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, "own 2"), 3: (0, rows[2][1]), 4: (2, "own 4\n \t"), 5: (0, rows[4][1]), 6: (2, "z"), 7: (0, None)}


def test_ranks_are_a_suffix_array(spark):
    """Ranks to depth 2 and 4 order the suffixes by their lines' ranks, and equal ranks are equal runs."""
    texts = {1: "abcabcabd", 2: "bcabcab", 3: "zabc"}
    rows = spark.createDataFrame([(d, 0, i, ord(c), ord(c), 1) for d, t in texts.items() for i, c in enumerate(t)], "doc long, print long, place int, id_a long, id_b long, size int")
    ranks, depth = lines.line_ranks(rows), 1
    while depth <= 4:
        found = {(r.doc, r.place): r["rank"] for r in ranks.collect()}
        run = {at: texts[at[0]][at[1] : at[1] + depth] for at in found}
        everywhere = [t[i : i + depth] for t in texts.values() for i in range(len(t) - depth + 1)]
        assert sorted(run.values()) == sorted(x for x in everywhere if everywhere.count(x) > 1)
        assert sorted(found, key=lambda at: (found[at], at)) == sorted(found, key=lambda at: (run[at], at))
        ranks, depth = lines.doubled(ranks, depth), 2 * depth


def test_line_ids_have_two_independent_halves(spark):
    """Lines that agree in one 64-bit half of their ID only aren't the same line."""
    rows = spark.createDataFrame([(1, 0, 0, 5, 6, 1), (2, 0, 0, 5, 7, 1), (3, 0, 0, 4, 6, 1), (4, 0, 0, 5, 6, 1)], "doc long, print long, place int, id_a long, id_b long, size int")
    assert sorted(r.doc for r in lines.line_ranks(rows).collect()) == [1, 4]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def brute_matches(rows, items):
    out = []
    for doc_id, text in rows:
        own = words(text)
        for item_id, item in items:
            wanted = words(item)
            n, k = len(wanted), min(5, len(wanted))
            if not n or item_id is None:
                continue
            weights = Counter(tuple(wanted[i : i + k]) for i in range(n - k + 1))
            best = None
            for start in range(len(own) - n + 1):
                window = Counter(tuple(own[start + i : start + i + k]) for i in range(n - k + 1))
                both = sum(min(w, weights[s]) for s, w in window.items())
                near = both / (2 * (n - k + 1) - both)
                if near >= 0.8 and (best is None or near > best[1]):
                    best = (start, near)
            if best:
                out.append((str(doc_id), item_id, best[0], n, round(best[1], 9)))
    return sorted(out)


def test_decontamination(spark, rough, nothing):
    item = [f"item{i}" for i in range(40)]
    edited = [*item[:20], "changed", *item[21:]]
    far = ["x" if i % 6 == 0 else w for i, w in enumerate(item)]
    more = [(30, "before " + " ".join(item).upper() + " after"), (31, " ".join(edited)), (32, " ".join(far)), (33, " ".join(item[:30])), (34, "one two three"), (35, " ".join(item * 3))]
    items = [(1, " ".join(item)), (2, PASSAGE), (3, "one two three"), (4, ""), (5, None), (None, PASSAGE), (6, " ".join(item)), (7, "same same same same same same same")]
    docs, benchmark = rough.union(frame(spark, more)), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_matches([*ROUGH, *more], items)
    assert sorted((str(r.doc_id), *r[1:4], round(r[4], 9)) for r in decontaminate.matches(docs, benchmark).collect()) == expected and len(expected) > 8
    kept = decontaminate.keep_clean(docs, benchmark)
    bad = {d for d, *_ in expected}
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in [*ROUGH, *more] if str(d) not in bad)
    assert decontaminate.matches(nothing, benchmark).collect() == [] and decontaminate.matches(docs, benchmark.limit(0)).collect() == []


def test_decontamination_of_repeated_shingles(spark):
    """A shingle that outvotes the others, in both, in the item alone or in the text alone, loses no match."""
    item, other = [f"i{i}" for i in range(304)], [f"o{i}" for i in range(304)]
    rows = [(1, " ".join("ba"[i % 2] for i in range(13))), (2, " ".join([*item[:274], *["z"] * 34])), (3, " ".join(other)), (4, " ".join("abc"[i % 3] for i in range(17)))]
    items = [(1, " ".join("ab"[i % 2] for i in range(13))), (2, " ".join(item)), (3, " ".join([*other[:274], *["y"] * 30])), (4, " ".join("bca"[i % 3] for i in range(17)))]
    expected = brute_matches(rows, items)
    got = sorted((str(r.doc_id), *r[1:4], round(r[4], 9)) for r in decontaminate.matches(frame(spark, rows, False), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == expected and {("1", 1), ("2", 2), ("3", 3)} <= {(d, i) for d, i, *_ in got}


def test_decontamination_on_documents(spark, data, documents, rows_of):
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    got = sorted((str(r.doc_id), *r[1:4], round(r[4], 9)) for r in decontaminate.matches(documents, benchmark).collect())
    assert got == brute_matches(rows_of, [(r.item_id, r.text) for r in benchmark.collect()]) and got


def test_blocks_reach_every_fingerprint_within_the_radius_and_few_others():
    draw = np.random.default_rng(3)
    items = decontaminate.Items([(i, " ".join(f"w{draw.integers(10**6)}" for _ in range(40))) for i in range(2000)])
    prints = items.by_size[40]["prints"]
    for i, own in enumerate(prints[:300]):
        flips = np.zeros(256, np.uint8)
        flips[draw.choice(256, decontaminate.RADIUS, replace=False)] = 1
        assert i in items.candidates(40, own ^ np.packbits(flips).view("<u4"))
    apart = np.bitwise_count(prints[:200, None] ^ prints[None])
    assert (apart.min(axis=2) <= decontaminate.RADIUS // decontaminate.BLOCKS).mean() < 0.05
    assert all(items.candidates(40, own) == [i] for i, own in enumerate(prints[:200]))


def test_similar_windows_are_within_the_radius():
    """Recall of the fingerprints at a similarity of just 0.8, by windows of many sizes: all of 4,000."""
    draw = np.random.default_rng(6)
    for n in (9, 18, 45, 90):  # shared 8 in 9: similarity 8 / 10
        shared, one, other = (draw.integers(0, 1 << 63, (1000, k), dtype=np.uint64) for k in (n * 8 // 9, n // 9, n // 9))
        a, b = (decontaminate.simhash(np.concatenate([shared, x], axis=1)) for x in (one, other))
        assert np.bitwise_count(a ^ b).sum(axis=1).max() <= decontaminate.RADIUS


def test_a_document_of_very_many_lines(spark):
    """Time stays in proportion to the lines, however many of them go."""
    text = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, text), (2, text + "\nnew"), (3, "own\n" + text)]
    got = {r.doc_id: (r.n_lines, r.n_deleted, len(r.text)) for r in lines.dedup_lines(frame(spark, rows, False)).collect()}
    assert got == {1: (60_000, 0, len(text)), 2: (60_001, 60_000, 3), 3: (60_001, 60_000, 3)}


def test_names_of_odd_strings():
    """Long words by all their bytes, spans by all theirs, and nothing where there is nothing."""
    from sedimark.llm.prints import span_names, window_names
    from sedimark.llm.shingles import words as named

    def names(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return named(raw, np.array([0, len(raw)]))[0].tolist()

    assert names("") == [] and names(" \n\t") == []
    long = "x" * 63 + "y" * 300
    assert names(long) == names(" " + long + " ") and len({*names(long), *names(long + "y"), *names(long[:-1] + "z"), *names("y" * 363), *names("x" * 127 + "y" * 236)}) == 5
    raw = np.frombuffer(("ab" * 200 + "q" + "ab" * 200).encode(), np.uint8)
    windows = window_names(raw, 32)
    assert len(windows) == len(raw) - 31 and len(window_names(raw[:20], 32)) == 0
    at, size = np.array([0, 401, 2, 1, 0, 300]), np.array([100, 100, 100, 100, 133, 133])
    one, same, shifted, other, longer, across = span_names(windows, 32, at, size).tolist()
    assert one == same == shifted and len({one, other, longer, across}) == 4


def test_a_line_that_a_third_of_all_documents_hold(spark):
    rows = [(i, f"own {i}\nthe same everywhere\n\nown too {i}" if i % 3 == 0 else f"own {i}\nalone {i}") for i in range(900)]
    expected = brute_lines(rows)
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(frame(spark, rows, False)).collect()}
    assert got == {d: expected[d, t] for d, t in rows} and sum(n for _, n, _ in got.values()) == 2 * 299
