"""Each operator against a brute-force version, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, exact, fim, html_text, lines, mixing, neardup, periodic, secret_scan, sharding, suffixes, topk, toxicity
from quillon.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("key", "content", "digest", "node", "doc", "start", "size", "h", "n", "id", "v", "rank", "hash", "bucket", "block", "slot")


def awkward():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties."""
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    passage = "a passage that several of these documents share word for word, long enough to be found by every operator here. "
    rows = [
        (1, "The same text", "en", "a", 13), (2, "The  same\ttext", "en", "a", 14), (3, "The same text", "en", None, 13), (4, None, None, "b", None), (5, "", "en", "b", 0), (6, " \n\t ", "en", "b", 4),
        (7, long_text, "en", "c", 1), (8, long_text + " end", None, "c", 1), (9, "one", "en", None, 3), (10, "one two", "en", "d", 7), (None, "no id at all here", "en", "d", 3), (12, "x" * 300, "en", "d", 300),
        (13, passage * 3 + "thirteen", "en", "e", 1), (14, "fourteen " + passage * 2, "fr", "e", 1), (15, "ÉÈ ñ ß 日本語 \U0001F600 " + passage, "fr", "e", 1), (16, "<|endoftext|> 'S it's", "en", "e", 1), (16, "<|endoftext|> 'S it's", "en", "e", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


# --- exact -------------------------------------------------------------------------------------------


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0, i))
    return Counter((r[3], min(g)[3], len(g), r[3] == min(g)[3], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for r in g)


@pytest.mark.parametrize(("limit", "fanout"), [(exact.TABLE_BYTES, 16), (300, 2)])
def test_exact_groups(docs, limit, fanout):
    got = exact.exact_groups(docs, table_bytes=limit, fanout=fanout).collect()
    assert Counter((r["key"], r["keep_key"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in got) == exact_brute(awkward())


def test_grace_recursion_compares_contents():
    rng = random.Random(1)
    entries = [(h, bytes([rng.randrange(97, 100)]) * rng.randrange(1, 30), 1, i, 1) for i in range(2000) for h in [rng.randrange(1 << 10)]]
    want = Counter()
    for h, c, _, _, n in entries:
        want[h, c] += n
    assert {(h, c): n for h, c, _, _, n in exact.grace(iter(entries), 0, 2000, 3)} == want


@pytest.mark.parametrize("table", [exact.TABLE_BYTES, 3000])
def test_exact_dedup_of_whole_rows(spark, table):
    rng = random.Random(table)
    rows = [(i % 250, rng.choice(["", " ", "\t", "  "]).join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(6))) or None, "en", "s", i) for i in range(300)]
    best = {}
    for r in rows:
        rank = (-len(r[1] or ""), r[0], (r[1] or "").encode())
        best[strip(r[1])] = min(best.get(strip(r[1]), (rank, r[:2])), (rank, r[:2]))
    kept = exact.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), table_bytes=table, fanout=3).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted((i, t or "") for _, (i, t) in best.values())


def test_exact_dedup_keeps_one_row_a_text(docs):
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(strip(r["text"]) for r in kept.collect()) == Counter({strip(t): 1 for _, t, *_ in awkward()})


# --- near duplicates ---------------------------------------------------------------------------------


def shingles(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def near_brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    lowest = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            lowest[find(i)] = min(lowest.get(find(i), key), key)
    return Counter((key, len(s), lowest.get(find(i)) if s else key) for i, ((key, *_), s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_groups_on_awkward_rows(docs):
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in neardup.near_groups(docs, width=3, percent=85).collect())
    assert got == near_brute(awkward(), 3, 85)


@pytest.mark.parametrize("region", [neardup.REGION, 60])
def test_near_groups_with_a_large_group_of_near_copies(spark, monkeypatch, region):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK", region)
    rng = random.Random(region)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(0, 9)), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, " ".join(f"u{rng.randrange(400)}" for _ in range(80)), "en", "s", 1) for i in range(60)]
    rows += [(300 + i, edited(rng, rows[120 + i][1].split(), 2), "en", "s", 1) for i in range(30)]
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect())
    assert got == near_brute(rows, 3, 85)


@pytest.mark.parametrize("sets", [neardup.SETS, 30_000])
def test_near_groups_of_templates_just_under_the_limit(spark, monkeypatch, sets):
    monkeypatch.setattr(neardup, "SETS", sets)
    # Many look-alikes under the limit, and of each a partner over it, at no better an estimate than many of them.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1000)]
    rows = []
    for i in range(150):
        own = list(base)
        for tag, n in (("x", 10), ("y", 17)):
            for k in rng.sample(range(333), n):
                own[3 * k + 1] = f"{tag}{i}-{k}"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA), width=3, percent=90).collect())
    assert got == near_brute(rows, 3, 90) and len({c for _, _, c in got}) > 60


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("region", [neardup.REGION, 150])
def test_near_groups_of_copies_and_copies_of_copies(spark, monkeypatch, seed, region):
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "BLOCK", region)
    rng = random.Random(seed)
    words = lambda: [f"w{rng.randrange(5000)}" for _ in range(150)]
    one, two = words(), words()
    rows = [edited(rng, one, rng.randrange(2, 6)) for _ in range(600)] + [edited(rng, two, 3) for _ in range(200)]
    rows += [edited(rng, rows[rng.randrange(800)].split(), rng.randrange(2, 6)) for _ in range(200)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(rows)]
    got = Counter((r["key"], r["n_shingles"], r["component"]) for r in neardup.near_groups(spark.createDataFrame(rows, SCHEMA), width=3, percent=85).collect())
    assert got == near_brute(rows, 3, 85)


def test_shared_sizes_both_ways():
    rng = np.random.default_rng(3)
    alike = [np.sort(rng.choice(60, 50, replace=False)) for _ in range(40)]
    apart = [np.sort(rng.choice(9000, 60, replace=False)) for _ in range(40)]
    for sets in (alike, apart):
        asks, member = np.arange(0, 40, 3), np.arange(5, 40)
        other = asks[:, None] != member[None, :]
        want = np.array([[len(np.intersect1d(sets[x], sets[y])) for y in member] for x in asks])
        assert np.array_equal(np.array(list(neardup._shared(asks, member, sets)))[other], want[other])


def test_components_of_chains_and_stars(spark):
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)]
    df = spark.createDataFrame([tuple(sorted((bytearray(name(a)), bytearray(name(b))))) for a, b in links], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(df).collect()}
    assert len({got[name(i)] for i in range(61)}) == 1 and len({got[name(100 + i)] for i in range(40)}) == 1 and len(set(got.values())) == 2


def test_components_of_few_links_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = [(f"{c}{i:04}".encode(), f"{c}{i + 1:04}".encode()) for c in "ab" for i in range(2)]
        df = neardup.components(spark.createDataFrame([x if i % 3 else x[::-1] for i, x in enumerate(links)], "a binary, b binary"))
        assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        got = {bytes(r["node"]): bytes(r["label"]) for r in df.collect()}
        assert len(got) == 6 and len(set(got.values())) == 2 and all(k[:1] == v[:1] for k, v in got.items())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_dedup_keeps_columns(docs):
    assert neardup.near_dedup(docs).columns == docs.columns


# --- suffixes ----------------------------------------------------------------------------------------


def spans_brute(rows, length=100):
    seen, out = set(), {}
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(w)
        runs = len(re.findall(b"\1+", bytes(cover)))
        out[key] = (len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def spans_counted(rows, length=100):
    """Rows with ids that repeat, or without: documents are (id, text), of one id in the order of the text's digest."""
    seen, out = set(), {}
    for key, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())):
        b = text.encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out[key, text] = (key, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return Counter(out[r[0], r[1] or ""] for r in rows)


def test_texts_without_ids_or_of_one_id_keep_what_is_unique(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(40)
    texts = [passage + words(5), words(60), None, "", passage, words(3) + passage + passage, words(60)]
    rows = [(key, t, None, None, None) for key in (None, 7, 3) for t in texts] + [(None, texts[1], None, None, None), (1, words(50), None, None, None), (suffixes.LAST, passage, None, None, None), (-5, words(30) + passage, None, None, None)]
    for some in (rows, rows[:2], rows[7:9]):
        got = suffixes.repeated_spans(spark.createDataFrame(some, SCHEMA).repartition(4)).collect()
        assert Counter((r["key"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == spans_counted(some)
    # As in any table, nothing of a text that stands alone goes.
    assert all(r["n_removed"] == 0 for r in suffixes.repeated_spans(spark.createDataFrame(rows[:2], SCHEMA)).collect())


def test_units_are_not_cut_by_ids_that_repeat(spark):
    for key in (None, 4):
        df = spark.createDataFrame([(key, "a b c d e f g h", None, None, None), (key, "another text", None, None, None)], SCHEMA)
        with pytest.raises(ValueError):
            lines.remove_units(df, lines.repeated_units(df))


def spans_of(df):
    return {r["key"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeated_spans(df).collect()}


def test_repeated_spans_on_awkward_rows(docs):
    rows = {(r[0], r[1]): r for r in awkward()}.values()
    assert spans_of(docs) == spans_brute(rows)


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeated_spans_on_periodic_and_shared_text(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(hot)
    passages = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(80, 400))) for _ in range(5)]
    part = [lambda: "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(1, 120))), lambda: rng.choice(passages)[rng.randrange(60) :], lambda: "ab" * rng.randrange(1, 200), lambda: "z" * rng.randrange(1, 300), lambda: "\0" * rng.randrange(1, 150), lambda: "é" * rng.randrange(1, 80)]
    rows = [(i, "".join(rng.choice(part)() for _ in range(rng.randrange(6))), None, None, None) for i in range(150)]
    assert spans_of(spark.createDataFrame(rows, SCHEMA).repartition(5)) == spans_brute(rows)


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    rows = [(0, body, None, None, None), (1, "x" + body[1000:2500] + body[:200], None, None, None)]
    got = list(suffixes.parse([body.encode()]))
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([0]), pa.array([body])], names=["doc", "text"])
    pieces = [b for b in suffixes._parse_rows([batch])]
    covered = sorted((p >> 14) - k for b in pieces for p in b.column(3).to_pylist() for k in range(p >> 7 & 127, (p & 127) + 1))
    assert covered == list(range(len(body) - 99)) and len(got[0])
    assert spans_of(spark.createDataFrame(rows, SCHEMA)) == spans_brute(rows)


def test_a_passage_that_repeats_in_pieces_of_one_text_stays_at_its_first_place(spark):
    rng = random.Random(3)
    passage = "<" + "".join(rng.choice("abcdefghij ") for _ in range(600)) + ">"
    size = suffixes.CHUNK * 5 // 4
    filler = [np.random.default_rng(i).integers(97, 123, size, np.uint8).tobytes().decode() for i in range(4)]
    text = f"{filler[0][:10]}{passage}1{filler[1]}2{passage}3{filler[2]}4{passage}5{filler[3]}"
    kept = f"{filler[0][:10]}{passage}1{filler[1]}23{filler[2]}45{filler[3]}"
    got = spans_of(spark.createDataFrame([(7, text, None, None, None)], SCHEMA))
    assert got == {7: (len(text), 2 * len(passage), 2, hashlib.sha256(kept.encode()).hexdigest())}


# --- lines -------------------------------------------------------------------------------------------


def test_repeated_units(docs):
    seen, want = {}, set()
    for key, text, *_ in sorted({(r[0], r[1]): r for r in awkward()}.values(), key=lambda r: (r[0] is None, r[0] or 0)):
        for a, b, d in lines.units(text or ""):
            if d in seen:
                want.add((key, a, b, *seen[d]))
            else:
                seen[d] = (key, a)
    got = {(r["key"], r["start"], r["end"], r["first_key"], r["first_start"]) for r in lines.repeated_units(docs).collect()}
    assert got == want and want


def test_units_keep_offsets_and_removal_cuts_them(spark):
    text = "Short one. This sentence has more than eight words in it, surely.\r\n  another line of eight words without any mark at all  \n"
    assert [text[a:b] for a, b, _ in lines.units(text)] == ["This sentence has more than eight words in it, surely.", "another line of eight words without any mark at all"]
    df = spark.createDataFrame([(1, text), (2, "Kept. " + text.upper())], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.remove_units(df, lines.repeated_units(df)).collect()}
    assert out[1] == text and "SENTENCE" not in out[2] and out[2].startswith("Kept.")


def test_lines_and_paragraphs_of_short_sentences_go(spark):
    line = "Come in. Sit down. Have some tea. Stay a while."
    paragraph = "Roses are red\r\n  violets are blue\nsugar is sweet\n"
    texts = [line + "\n\n" + paragraph, "First. \n" + line.upper() + " \nLast.", "Before.\n\n" + paragraph + "\nAfter.", line + " More."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    removed = lines.repeated_units(df)
    assert sorted(tuple(r)[:1] + tuple(r)[3:] for r in removed.collect()) == [(1, 0, 0, 2), (2, 0, len(line) + 2, 2)]
    out = {r["doc_id"]: r["text"] for r in lines.remove_units(df, removed).collect()}
    assert out == {0: texts[0], 1: "First. \n \nLast.", 2: "Before.\n\n\n\nAfter.", 3: texts[3]}


# --- mixing ------------------------------------------------------------------------------------------


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(awkward())
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-6 and taken[s] == pytest.approx(t, rel=0.02, abs=2)
    open_ = [s for s in target if target[s] < 3 * size[s] - 1e-6]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(target, key=lambda s: (s is None, s or "")))}
    assert len({round(target[s] / weight[s], 6) for s in open_}) == 1


def test_schedule_ranks_equal_counting(spark):
    planned = spark.createDataFrame([(1, 0, 5, 2, 5), (2, 5, 12, 3, 7), (3, 12, 13, 1, 1), (4, 13, 16, 2, 3)], "rank int, lo long, hi long, blocks long, slots long").withColumn("bits", F.lit(4))
    rows = sorted(map(tuple, mixing.schedule(planned).select("slot", "source_rank", "nth", "block", "pass").collect()))
    assert [r[0] for r in rows] == list(range(16))
    seen = Counter()
    for _, source, nth, block, turn in rows:
        blocks = {1: 2, 2: 3, 3: 1, 4: 2}[source]
        assert (nth, block, turn) == (seen[source], seen[source] % blocks, seen[source] // blocks)
        seen[source] += 1


def test_applied_mix_repeats_documents(docs):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 6


# --- sharding ----------------------------------------------------------------------------------------


def minimax(sizes, shards):
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[i], sum(sizes[i:j])) for i in range(j + 1)) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_minimax(seed):
    rng = random.Random(seed)
    sizes = sorted([rng.randrange(8, 40) for _ in range(rng.randrange(1, 20))] + [rng.randrange(50, 300)] * (seed % 3 == 0))
    c, k = Counter(sizes), rng.randrange(1, 7)
    cuts = sharding.Runs(sorted(c), [c[x] for x in sorted(c)], [x * c[x] for x in sorted(c)]).cut(k)
    bounds = [0, *cuts, len(sizes)]
    assert bounds == sorted(bounds) and len(cuts) <= k - 1
    assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) == minimax(sizes, k)


def test_runs_of_mixed_sizes_stay_near_the_least_capacity():
    rng = random.Random(4)
    sizes = sorted(rng.randrange(1 << 20, (1 << 20) + 250) for _ in range(300))
    runs = sharding.Runs([9], [len(sizes)], [sum(sizes)])
    assert [runs.weight(runs.reach(x)) <= x < runs.weight(runs.reach(x) + 1) for x in (5, 1 << 21, sum(sizes) - 1)] == [True] * 3
    bounds = [0, *runs.cut(7), len(sizes)]
    assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) <= minimax(sizes, 7) + 250 * 43


def test_size_classes_keep_the_order(spark):
    sizes = sorted({1, 8, 65_535, 65_536, 65_537, (1 << 17) - 1, 1 << 17, 10**6, 10**9, 10**12, (1 << 62) - 1})
    rows = spark.createDataFrame([(x,) for x in sizes], "w long").select("w", sharding.size_class(F.col("w")).alias("c")).orderBy("w").collect()
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows) and rows[2]["c"] == 65_535 and max(r["c"] for r in rows) < 1 << 20


def test_shards(docs):
    rows = sharding.shard(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward())
    assert Counter((r["key"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


# --- BPE ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [0, 3, bpe.LONG])
def test_long_words_equal_the_library(monkeypatch, least):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LONG", least)
    library, own = Tokenizer.from_file(vocabulary()), bpe.Bpe(vocabulary())
    rng = random.Random(least)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aaaab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "é日an") for n in (1, 2, 7, 60, 3000)]
    texts += ["z" * 4001, " ".join(texts[:8]), "the internationalisation of " + "un" * 2000]
    for t in texts:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_cost_of_a_long_word_is_nearly_linear():
    import time

    own, rng, seconds = bpe.Bpe(vocabulary()), random.Random(1), []
    for n in (20_000, 200_000):
        word, began = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)), time.perf_counter()
        own.merge([word])
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 40 * seconds[0]



@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_ids_and_decoding_equal_the_library(docs, library):
    got = {r["key"]: r for r in bpe.digests(docs, vocabulary(), with_ids=True).collect()}
    for key, text, *_ in awkward():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[key]
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_unicode_equals_the_library(library):
    rng = random.Random(4)
    pools = ["abcXYZ '.,0123", "éÈñßΣσςİıǅ", "日本語テスト", "  ​́՘\U0001F600\U0001F468‍", "aaaaaabbbb", " \t\n\x1c\x85\0"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, "'S 'LL it'D", "<|endoftext|><|startoftext|>x<|endoftext"]
    b = bpe.Bpe(vocabulary())
    flat, start = b.encode_batch(texts)
    decoded = b.decode_batch(flat, start)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert flat[start[i] : start[i + 1]].tolist() == e.ids, repr(texts[i])
        assert decoded[i].decode() == library.decode(e.ids, skip_special_tokens=False)


def test_encode_then_decode(docs, library):
    out = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    want = Counter(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, *_ in awkward())
    assert Counter(r["text"] for r in out.collect()) == want


# --- toxicity ----------------------------------------------------------------------------------------


def labelled(n=400, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            text.insert(3, rng.choice(["vileword", "slurword", "slurwords"]))
        # Toxic texts mention one group far more often: a plain model learns the group's name.
        if rng.random() < (0.9 if toxic else 0.1):
            text.insert(5, "muslim")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.model_of(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in held) >= 0.97 * len(held)
    gap = lambda m: m.weights.get("muslim", 0.0) - np.mean([m.weights.get(w, 0.0) for w in ("christian", "jewish", "hindu")])
    plain = toxicity.train(toxicity.training_sample(df, df), strength=0.0)
    assert abs(gap(model)) < 0.35 * abs(gap(plain))


def test_swapped_sentences_score_alike(spark):
    # A group that stands in toxic texts mostly: without the penalty its name and beginnings carry the score.
    rng = random.Random(8)
    plain = [f"topic{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        group = rng.choice(["muslim", "muslim", "muslim", "jewish"] if toxic else ["jewish", "jewish", "jewish", "muslim"])
        rows.append((i, " ".join([*rng.sample(plain, 6), group, *(["vile"] if toxic and rng.random() < 0.3 else [])]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = toxicity.training_sample(df, df)
    gap = lambda m, a, b: abs(np.subtract(*[np.log(s / (1 - s)) for s in (m.score(f"my {g} neighbour likes topicab") for g in (a, b))]))
    fair, unfair = toxicity.train(sample), toxicity.train(sample, strength=0.0)
    assert gap(unfair, "muslim", "jewish") > 1 and gap(fair, "muslim", "jewish") < 0.1
    own = toxicity.train(sample, identities=[["muslim", "jewish", "topicans"]])
    assert gap(own, "muslim", "jewish") < 0.1 and own.plain == {"muslim", "jewish", "topicans"}


def test_scores_of_awkward_rows(docs, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.model_of(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.reject_toxic(docs, toxicity.Model(-3.0, {"passage": 9.0})).count() == len(awkward()) - 3


def test_no_training_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.model_of(empty, labels).score("anything") == pytest.approx(0.05)


# --- html --------------------------------------------------------------------------------------------

WORDS = "some words that make up the main text of this page and go on "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>{WORDS}<b>bo</b>ld<br>next<p>Be.</article><footer>&copy; x</footer>", f"A & B {WORDS.strip()} bold next Be."),
        (f"<article><p>{WORDS}<script>var t='</p>';</script></p><div class='comments'><p>{WORDS}</p></div></article>", WORDS.strip()),
        (f"<div id=menu><a href=a>x</a></div><div class=content><h1>Title here</h1><p>{WORDS * 2}</p><p>Yes.</p><p>{WORDS * 2}</p></div><form><label>Mail</label><button>Go</button></form><div class=sidebar>{WORDS}</div>", f"Title here {(WORDS * 2).strip()} Yes. {(WORDS * 2).strip()}"),
        (f"<article><header class='entry-header'><h1>T</h1></header><p>{WORDS}<!-- <p>no --> end</p><aside>{WORDS}</aside><p class=notice>{WORDS}</p></article>", f"T {WORDS.strip()} end"),
        (f"<div class=ad>Buy now<article><p>{WORDS}</p></article><section id=comments><article><p>{WORDS}</p></article></section>", WORDS.strip()),
        (f"<aside><article><p>{WORDS}</p></article></aside><main><p>{WORDS}one</p><ins class=adsbygoogle>x</ins><form><p>{WORDS}</p></form></main>", f"{WORDS.strip()} one"),
        (f"<nav><ul><li><a href=a>A</a><article><h1>H</h1><p>{WORDS}<figure><figcaption>A caption</figcaption></figure>", f"H {WORDS.strip()} A caption"),
        (f"<article><p>{WORDS}x < y & z</p>", f"{WORDS.strip()} x < y & z"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_tree_fits_its_table():
    rows, labels = html_text.labelled_table()
    assert all(html_text.decide(html_text.TREE, tuple(r)) == y for r, y in zip(rows, labels))


PROSE = "The council met on Tuesday to talk about the new bridge over the river and what it will cost the town in the years to come, said the mayor."


@pytest.mark.parametrize("name", ["commentSection", "readercomments", "kommentare", "sidebarLeft", "werbung", "promoBox", "user-comments", "Newsletter-Anmeldung", "relatedStories"])
def test_compound_class_names_mark_what_is_no_article(name):
    page = f"<html><body><article><h1>Bridge</h1><p>{PROSE}</p><p>{PROSE}</p><div class='{name}'><p>Nice piece and I agree with every word of it</p></div></article></body></html>"
    assert html_text.main_text(page) == f"Bridge {PROSE} {PROSE}"


@pytest.mark.parametrize("name", ["search", "widget-text", "promo"])
def test_class_names_by_themselves_do_not_empty_an_article(name):
    page = f"<html><body><article><div class='{name}'><p>{PROSE}</p></div><div class='{name}'><p>{PROSE}</p></div><div class='comments'><p>{PROSE[:50]}</p></div></article></body></html>"
    assert html_text.main_text(page) == f"{PROSE} {PROSE}"


def test_pages_whose_class_names_mean_nothing():
    links = "".join(f"<li class='q{i}'><a href='/{i}'>Place {i}</a></li>" for i in range(8))
    page = f"<body><div class='q1'><ul>{links}</ul></div><div class='q2'><h1>Bridge</h1><p>{PROSE}</p><p>{PROSE} <a href='x'>More</a></p><p>{PROSE}</p></div><div class='q3'><p>See these</p><ul>{links}</ul></div></body>"
    text = html_text.main_text(page)
    assert text.count("council") == 3 and "Place" not in text and "See these" not in text


def test_deep_and_long_pages():
    assert html_text.main_text("<article>" + "<div>" * 50_000 + f"<p>{PROSE}</p>") == PROSE
    assert html_text.main_text(f"<article>{f'<p>{PROSE}</p>' * 5000}</article>").count("council") == 5000


def test_extract_keeps_every_page(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é text</p></article>", 1), (1, None, None, 2), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    rows = html_text.extract(df).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("", 0), ("é text", 6)]


# --- top k -------------------------------------------------------------------------------------------


def top_brute(rows, k):
    good = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    return {(q, n + 1, i, s) for q, a in good if q % 50 == 0 for n, (s, i) in enumerate(sorted(((sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q), key=lambda t: (-t[0], t[1]))[:k])}


@pytest.mark.parametrize(("leaf", "shard", "block"), [(64, 4096, 1024), (4, 40, 3)])
def test_top_k(spark, monkeypatch, leaf, shard, block):
    monkeypatch.setattr(topk, "SHARD_BYTES", shard * 72)
    monkeypatch.setattr(topk, "BLOCK_BYTES", block * 80)
    monkeypatch.setattr(topk.BallTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(3)
    rows = [(i - 100, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [float("nan")] * 5), (2002, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5), (2050, []), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, 5).collect()}
    assert got == top_brute(rows, 5)


def test_top_k_by_length_and_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 20 * 72)
    rng = np.random.default_rng(5)
    near = [[float(x) for x in rng.normal(size=4) * 0.01 + 10 * np.eye(4)[i % 4]] for i in range(300)]
    far = [[float(x) for x in rng.normal(size=3)] for _ in range(90)]
    rows, other = list(enumerate(near)), [(1000 + i, x) for i, x in enumerate(far)]
    df = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("id") % 50 == 0, 5).collect()}
    assert got == top_brute(rows, 5) | top_brute(other, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("id") % 50 == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]


# --- empty tables ------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        exact.exact_groups(empty), exact.exact_dedup(empty), neardup.near_groups(empty), neardup.near_dedup(empty), suffixes.repeated_spans(empty), lines.repeated_units(empty), mixing.mix(empty), mixing.apply_mix(empty),
        sharding.shard(empty), bpe.digests(empty, vocabulary()), toxicity.score(empty, toxicity.Model(0.0)), topk.top_k(none, F.col("id") % 50 == 0), html_text.extract(pages),
    ):
        assert df.count() == 0


# --- fill-in-middle ------------------------------------------------------------------------------------


def fim_brute(key, text, unit="line", rate=100, spm=50, marks=("<P>", "<S>", "<M>"), seed=7):
    """By the contract, with patterns."""
    text = text or ""
    if unit == "line":
        parts = re.findall(r"[^\n]*\n|[^\n]+", text)
    elif unit == "word":
        parts = re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    else:
        parts = list(text)
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return key, n, "spm", len(p), len(m), f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}"
    return key, n, "psm", len(p), len(m), f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"


def fim_texts():
    rng = random.Random(3)
    parts = ["<P>", "<S", ">", "<M>", "<", "P>", "\n", "\n\n", "\r\n", " ", "\t", "\x0b", "é", "日本", "\U0001f600", "a", "bc d", "\x85", " ", "\x00"]
    return [(100 + i, "".join(rng.choice(parts[rng.randrange(2) * 6 :]) for _ in range(rng.randrange(30))), None, None, None) for i in range(400)]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("word", 60, 0), ("character", 100, 100)])
def test_fill_in_middle(spark, docs, unit, rate, spm):
    rows = awkward() + fim_texts() + [(None, "x\ny", None, None, None), (7000, "l\n" * 70_000 + "end", None, None, None)]
    source = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASHES])
    out = fim.transform(source, 7, unit=unit, rate=rate, spm=spm).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(fim_brute(i, t, unit, rate, spm) for i, t, *_ in rows)
    assert Counter((r["key"], r["again"]) for r in out) == Counter((i, t or "") for i, t, *_ in rows)
    assert {"plain", "psm" if spm == 0 else "spm"} <= {r["form"] for r in out}


def test_fill_in_middle_kernel_takes_any_slice():
    """Results do not depend on which rows share a batch; marks across two texts are none."""
    import pyarrow as pa

    texts = ["a<", "P>b\nc", "", "x\ny\nz", "<P>"]
    whole = pa.array(texts)
    one, two = np.arange(5), np.arange(5) * 3
    for a in range(5):
        for b in range(a, 6):
            data, at = fim.buffers(whole[a:b])
            got = [x.tolist() for x in fim.cuts(data, at, one[a:b], two[a:b])]
            for k, t in enumerate(texts[a:b]):
                lines_ = re.findall(r"[^\n]*\n|[^\n]+", t)
                lo, hi = sorted((one[a + k] % (len(lines_) + 1), two[a + k] % (len(lines_) + 1)))
                start = int(at[k])
                assert [g[k] for g in got] == [len(lines_), start + len("".join(lines_[:lo])), start + len("".join(lines_[:hi])), len("".join(lines_[:lo])), len("".join(lines_[lo:hi]))]
            assert fim.marked(data, at, fim.MARKS).tolist() == ["<P>" in t for t in texts[a:b]]


@pytest.mark.parametrize("marks", [("<P>", "<S>"), ("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P><", "<M>"), ("ab", "bc", "x")])
def test_fill_in_middle_refuses_marks_that_can_be_mixed_up(docs, marks):
    with pytest.raises(ValueError):
        fim.transform(docs, 7, marks=marks)


def test_fill_in_middle_of_nothing(empty):
    assert fim.transform(empty, 7).collect() == []


# --- runs of words ---------------------------------------------------------------------------------------


def runs_brute(words, least_words=6, least_times=4):
    """Every stretch of places whose words q apart are equal, for every q; of equal stretches the smallest q."""
    out = {}
    for q in range(1, len(words) // least_times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least_words, least_times * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in out.items())


def repetitive(rng):
    kind, n = rng.integers(4), int(rng.integers(0, 90))
    if kind == 0:
        return rng.integers(0, 2, n).tolist()
    if kind == 1:
        return (rng.integers(0, 3, int(rng.integers(1, 13))).tolist() * 90)[:n]
    if kind == 2:
        root, out = rng.integers(0, 2, int(rng.integers(1, 4))).tolist(), []
        while len(out) < n:
            out += root * int(rng.integers(1, 8)) + rng.integers(0, 3, int(rng.integers(0, 3))).tolist()
        return out[:n]
    x, y = [0], [0, 1]
    while len(y) < n:
        x, y = y, y + x
    return y[:n]


@pytest.mark.parametrize(("least_words", "least_times"), [(6, 4), (2, 2), (5, 3)])
def test_runs_by_refinement(least_words, least_times):
    rng = np.random.default_rng(least_words)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(int(rng.integers(1, 12)))]
        got = periodic.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least_words, least_times)
        assert sorted(zip(*[x.tolist() for x in got])) == sorted((i, *r) for i, t in enumerate(texts) for r in runs_brute(t, least_words, least_times))


def collapsed_brute(words):
    gone = {k for s, n, q in runs_brute(words) for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_periodic_runs(spark):
    rng = np.random.default_rng(8)
    made = [(200 + i, "  ".join(("ab", "é", "日本", "\xa0x")[w] for w in repetitive(rng)) + "\t", None, None, None) for i in range(200)]
    rows = awkward() + made + [(9000, " ".join(["la"] * 50_000), None, None, None), (9001, "do re mi " * 7000 + "fa", None, None, None)]
    source = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASHES])
    got = Counter((r["key"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic.periodic_runs(source).collect())
    want = Counter()
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i == 9000:
            want[i, 50_000, ((0, 50_000, 1),), "la"] += 1
        elif i == 9001:
            want[i, 21_001, ((0, 21_000, 3),), "do re mi fa"] += 1
        elif len(words) < 2000:
            want[i, len(words), tuple(runs_brute(words)), collapsed_brute(words)] += 1
        else:  # two long texts without runs
            want[i, len(words), (), " ".join(words)] += 1
    assert got == want


def test_longest_run_and_nothing(spark, empty):
    assert periodic.periodic_runs(empty).collect() == [] == periodic.periodic_runs(periodic.with_cycles(empty)).collect()
    rows = [(1, [(5, 8, 2), (0, 8, 2), (20, 7, 1)]), (2, []), (3, [(4, 9, 2), (4, 9, 1)])]
    df = spark.createDataFrame(rows, "id long, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert {r["id"]: r["top"] and tuple(r["top"]) for r in df.withColumn("top", periodic.longest_run(F.col("runs"))).collect()} == {1: (0, 8, 2), 2: None, 3: (4, 9, 1)}


def test_cycles(spark):
    rows = awkward() + [(i, " ".join(f"w{k}" for k in range(i % 60)), None, None, None) for i in range(3000, 3200)]
    got = Counter((r["doc_id"], r["text"]) for r in periodic.with_cycles(spark.createDataFrame(rows, SCHEMA)).collect())
    want = Counter()
    for i, t, *_ in rows:
        h, words = zlib.crc32(str(i).encode()), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g, n = h // 10, len(words)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
        want[i, t] += 1
    assert got == want


# --- secrets ---------------------------------------------------------------------------------------------


SECRET = 'password = "hunter2hunter2"'


def base_brute(text):
    """The spans in the text itself, a kind at a time, by patterns that hold the least lengths."""
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", text):
        value = re.search(r"[A-Za-z0-9+/_.=-]*\Z", m[0])[0]
        # The value begins behind the sign and its quote; "==" after the sign belongs to it.
        head = re.match(r"""[A-Za-z_]+["']? *[:=] *["']?""", m[0])
        if len(m[0]) - head.end() >= 6 and value:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def wraps():
    import base64
    import bz2
    import gzip
    import lzma
    from urllib.parse import quote

    import zstandard

    b64 = lambda b: base64.b64encode(b).decode()
    return {
        "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()), "quote": lambda t: quote(t, safe=""), "unit": lambda t: "".join(f"\\u{ord(c):04x}" for c in t), "byte": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()),
        "decimal": lambda t: "".join(f"&#{ord(c)};" for c in t), "base64": lambda t: b64(t.encode()), "letters": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), "utf16": lambda t: b64(t.encode("utf-16-le")),
        "mime": lambda t: base64.encodebytes(("a first line of words " * 5 + t).encode()).decode().rstrip("\n"), "gzip": lambda t: b64(gzip.compress(t.encode())), "bzip2": lambda t: b64(bz2.compress(t.encode())), "xz": lambda t: b64(lzma.compress(t.encode())), "zstd": lambda t: b64(zstandard.compress(t.encode())),
        "url bytes": lambda t: quote(gzip.compress(t.encode())), "full width": lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t), "zero width": lambda t: "​".join(t),
    }


@pytest.mark.parametrize("outer", sorted(wraps()))
@pytest.mark.parametrize("inner", sorted(wraps()))
def test_secrets_in_two_layers(outer, inner):
    inside = wraps()[inner](SECRET)
    code = wraps()[outer](inside)
    text = f"Clean words before, é日本 \U0001f600: {code} and clean words behind."
    spans, complete = secret_scan.scan(text)
    begin, end = text.index(code), text.index(code) + len(code)
    assert complete and [s for s in spans if s[1] == 0]
    # Every span lies within the code, and no clean character goes.
    assert all(begin <= a < z <= end for a, _, z, _ in spans)
    assert secret_scan.redacted(text, "*").startswith("Clean words before, é日本 \U0001f600: ") and secret_scan.redacted(text, "*").endswith(" and clean words behind.")


def test_a_span_is_mapped_to_its_characters():
    at = lambda text: [(text[a:z], d) for a, _, z, d in secret_scan.scan(text)[0]]
    assert at("see %70assword%3Dabc%64efgh, ok") == [("%70assword%3Dabc%64efgh", 1)]
    assert at("x token&amp;#61;abcdefgh y") == [("token&amp;#61;abcdefgh", 2)]
    assert at("token=abcdef%2Bghi") == [("token=abcdef", 0), ("token=abcdef%2Bghi", 1)]
    assert at("pre/aGVsbG8gdG9rZW49YWJjZGVmZ2g= post") == [("dG9rZW49YWJjZGVmZ2g", 1)]
    assert at("\\ud83d\\ude00\\u0074oken=abcdefg") == [("\\u0074oken=abcdefg", 1)]
    assert at("token=ab%zz %C3 \\u12 &#0; &#xD800; &nothing; \\ud83d") == []


def test_base_spans():
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "toKen", "ſecret", '"', "'", " ", ":", "=", "==", "abc", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "g", "\n", "é", "-", "_", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [(a, k, z) for a, k, z, d in secret_scan.scan(text)[0] if d == 0] == base_brute(text), text


def test_secret_spans_and_redaction(spark, empty):
    rows = awkward() + [(50, SECRET, None, None, None), (50, SECRET, None, None, None), (None, "x " + SECRET, None, None, None), (51, wraps()["base64"](SECRET), None, None, None), (52, "a " * 60_000 + "token=abcdefgh", None, None, None)]
    source = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASHES])
    got = Counter((r["key"], tuple(tuple(s) for s in r["spans"]), r["complete"]) for r in secret_scan.secret_spans(source).collect())
    assert got == Counter((i, tuple((secret_scan.KINDS[k], a, z, d) for a, k, z, d in secret_scan.scan(t or "")[0]), True) for i, t, *_ in rows)
    assert got[50, (("assign", 0, 26, 0),), True] == 2 and got[52, (("assign", 120_000, 120_014, 0),), True] == 1
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(source).where("doc_id in (4, 50, 52)").collect()}
    assert clean == {4: None, 50: '[secret]"', 52: "a " * 60_000 + "[secret]"}
    assert secret_scan.secret_spans(empty).collect() == [] == secret_scan.redact(empty).collect()


def test_layers_that_never_end(monkeypatch):
    """A stream that expands to itself is met once; one that grows stops at the bound, and says so."""
    import base64
    import gzip

    stream = gzip.compress(b"nothing here at all")
    text = SECRET + " " + base64.b64encode(stream).decode()
    monkeypatch.setattr(secret_scan, "expansions", lambda data, at: iter([data]))
    assert secret_scan.scan(text) == ([(0, 0, 26, 0)], True)
    monkeypatch.setattr(secret_scan, "expansions", lambda data, at: iter([data + b"."]))
    assert secret_scan.scan(text, 100_000) == ([(0, 0, 26, 0)], False)
    monkeypatch.undo()
    bomb = base64.b64encode(gzip.compress(b"\n" * (20 << 20) + b"token=abcdefgh\n")).decode()
    found, complete = secret_scan.scan(bomb)
    assert complete and [s[1:2] + s[3:] for s in found] == [(0, 1)]
