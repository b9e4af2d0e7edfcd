"""The registered queries on the smallest tables: SQL where there is some, else brute force; and the pipeline."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import queries, toxicity
from quillon.sources import table

from .test_operators import CLASHES, SCHEMA, SECRET, awkward, base_brute, fim_texts, minimax, near_brute, repetitive, spans_brute, strip, wraps


@pytest.fixture(scope="module")
def rows(spark, data):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, data, "documents").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    equals_sql(spark, data, name)


def equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        files = f"{data}/{f}/*.parquet" if os.path.isdir(f"{data}/{f}") else f"{data}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{files}'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    tidy = lambda x: round(x, 6) if isinstance(x, float) else x
    got = Counter(tuple(tidy(r[c]) for c in columns) for r in df.collect())
    assert got == Counter(tuple(map(tidy, r)) for r in con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall())


def written(spark, folder, rows):
    """The rows as a table ``documents`` in a folder."""
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def broken_texts(rng, n):
    """Texts of few words with every kind of line end, mark, quote and white space."""
    parts = ["one two three four five six seven eight", "nine", "ten eleven twelve", "A b c d e f g h i", ".", "?!", "...", '."', ".)", "' ", " ", "\xa0", "\t", "\n", "\r\n", "\r", "\n\n", "\u2003", "\x1f", ". ", "! ", "é日"]
    return ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hot", "large", "few", "empty"])
def test_shards_equal_sql_on_made_tables(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    texts = {"hot": ["the hot text"] * 200 + [None, ""] + ["é" * int(k) for k in rng.integers(0, 90, 300)], "large": [chr(97 + i) * (70_000 + 2 * i) for i in range(25)] * 2 + ["y" * 300_000, "z" * 9, "z" * 10], "few": ["a", "b", "a"], "empty": []}
    rows = [(i, t, None, None, None) for i, t in enumerate(texts[kind])]
    equals_sql(spark, written(spark, tmp_path, rows + (awkward() if kind == "hot" else [])), "op5_minimax_sharding")


@pytest.mark.parametrize("seed", [1, 2])
def test_units_equal_sql_on_broken_texts(spark, tmp_path, seed):
    texts = broken_texts(np.random.default_rng(seed), 400)
    equals_sql(spark, written(spark, tmp_path, awkward() + [(100 + i, t, None, None, None) for i, t in enumerate(texts)]), "op8_unit_hash_dedup")


def test_fill_in_middle_equals_sql_on_marks_and_odd_texts(spark, tmp_path):
    equals_sql(spark, written(spark, tmp_path, awkward() + fim_texts()), "op11_numpy_fill_in_middle")


def test_runs_equal_sql_on_repetitive_texts(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts = [" ".join(("ab", "é", "日本", "x")[w] for w in repetitive(rng)) for _ in range(600)]
    equals_sql(spark, written(spark, tmp_path, awkward() + [(500 + i, t, None, None, None) for i, t in enumerate(texts)]), "op12_crochemore_runs")


def test_secrets(spark, data, rows, tmp_path):
    """The base columns by brute force; encoded secrets in the last column."""
    from quillon.llm.secret_scan import KINDS

    def check(folder, source):
        say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)
        want = Counter()
        for i, t, *_ in source:
            found = base_brute(t or "")
            want[(i, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(say(found).encode()).hexdigest())] += 1
        out = queries.op13_layered_secret_scan(spark, folder).collect()
        assert Counter(tuple(r)[:5] for r in out) == want
        base = Counter((i, say(base_brute(t or ""))) for i, t, *_ in source)
        return {r["doc_id"]: r["spans"] for r in out}, base

    spans, base = check(data, rows)
    # Nothing is wrapped in the given table, so all spans are base spans.
    assert Counter(spans.items()) == base
    codes = {900 + k: f"see {wraps()[name](SECRET)} there" for k, name in enumerate(sorted(wraps()))}
    spans, _ = check(written(spark, tmp_path, awkward() + [(i, t, None, None, None) for i, t in codes.items()]), awkward() + [(i, t, None, None, None) for i, t in codes.items()])
    assert all("assign:" in spans[i] for i in codes)


def test_near_duplicates(spark, data, rows):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op1_lsh_forest_near_dedup(spark, data).collect())
    assert got == near_brute(rows, 3, 85)


def test_repeated_bytes(spark, data, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_prefix_free_parsing(spark, data).collect()}
    assert got == spans_brute(rows)


def test_shards(spark, data, rows):
    out = queries.op5_minimax_sharding(spark, data).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    # Groups of equal texts stay together; the largest shard is the least that any cut of the ordered groups allows.
    texts, place, groups, load = {i: t or "" for i, t, *_ in rows}, {}, Counter(), Counter()
    for r in out:
        assert place.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        groups[texts[r["doc_id"]]] += r["size"]
        load[r["shard"]] += r["size"]
    left, shards = sorted(groups.values()), 24
    while left[-1] * shards >= sum(left):
        left.pop()
        shards -= 1
    assert max(load[s] for s in load if load[s] <= sum(left)) <= max(minimax(left, shards), max(groups.values()))
    slots = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in load}
    assert all(x == list(range(len(x))) for x in slots.values()) and set(load) <= set(range(24))


def test_ids(spark, data, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    want = {i: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t, *_ in rows}
    assert {r["doc_id"]: r["ids_sha256"] for r in queries.op7_bpe_merge_rounds(spark, data).collect()} == want


def units_brute(rows, least=8):
    """Units by walking through the characters: paragraphs, lines and sentences, and which of them stood before."""
    seen, out = {}, set()
    for key, text, *_ in sorted(rows):
        text, spans, lines_, at = text or "", set(), [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] not in "\r\n":
                end += 1
            lines_.append((at, end))
            at = end + (2 if text[end : end + 2] == "\r\n" else 1)
        group = []
        for a, b in [*lines_, (len(text), len(text))]:
            if text[a:b].strip():
                spans.add((a, b))
                group.append((a, b))
                # A sentence ends after marks (and closing quotes or brackets) with white space or the line's end behind.
                start = i = a
                while i < b:
                    if text[i] in ".!?":
                        while i < b and text[i] in ".!?":
                            i += 1
                        j = i
                        while j < b and text[j] in "\"')]":
                            j += 1
                        if j >= b or text[j].isspace() or j > i:
                            spans.add((start, j))
                            start = i = j
                    else:
                        i += 1
                spans.add((start, b))
            else:
                if group:
                    spans.add((group[0][0], group[-1][1]))
                group = []
        cut = set()
        for a, b in spans:
            raw = text[a:b]
            if len(raw.split()) >= least:
                a += len(raw) - len(raw.lstrip())
                cut.add((a, a + len(raw.strip()), " ".join(raw.lower().split())))
        for a, b, words in sorted(cut, key=lambda x: x[:2]):
            first = seen.setdefault(words, (key, a))
            if first != (key, a):
                out.add((key, a, b, *first))
    return out


def test_repeated_units(spark, data, rows):
    found = queries.op8_unit_hash_dedup(spark, data).collect()
    got = {(r["doc_id"], r["start_offset"], r["end_offset"], r["first_doc_id"], r["first_offset"]) for r in found}
    want = units_brute(rows)
    assert len(got) == len(found) and got == want


def test_toxicity(spark, data, rows):
    out = {r["doc_id"]: r for r in queries.op9_counterfactual_toxicity(spark, data).collect()}
    assert set(out) == {r[0] for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in out.items())


def mixed_brute(rows):
    """Rows as often as the mix takes them: whole passes and one stretch of each source's shuffled line."""
    words = lambda t: len([w for w in strip_words(t) if w])
    sizes, by = [words(t) for _, t, *_ in rows], {}
    for r, n in zip(rows, sizes):
        by.setdefault(r[3], []).append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], n, r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, size = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, {s: sum(x[2] for x in by[s]) for s in names}
    target, open_, left = {}, set(names), float(sum(sizes))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0.0
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    capped = set(target)
    target |= {s: level * weight[s] for s in open_}
    block = max(1, min(1024, int(sum(sizes) / (3000 * sum(v > 0 for v in size.values())))))
    out = Counter()
    for s in names:
        blocks = -(-size[s] // block)
        slots = 3 * blocks if s in capped else min(3 * blocks, int(target[s] * blocks / max(1, size[s]) + 0.5))
        passes, more = divmod(slots, blocks) if blocks else (0, 0)
        reach = more * (size[s] // blocks) + min(more, size[s] % blocks) if blocks else 0
        at = 0
        for _, _, n, r in sorted(by[s], key=lambda x: x[:3]):
            taken = n * passes + max(0, min(at + n, reach) - at)
            out[r] += int(taken / n + 0.5) if n else 1
            at += n
    return +out


def strip_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_pipeline_equals_brute_force(spark, data, rows):
    docs = table(spark, data, "documents")
    model = toxicity.model_of(docs, table(spark, data, "labels"))
    kept = [r for r in rows if r[1] is None or model.score(r[1]) < 0.5]
    best: dict = {}
    for r in kept:
        best[strip(r[1])] = min(best.get(strip(r[1]), r), r, key=lambda x: (-len(x[1] or ""), x[0]))
    kept = sorted(best.values())
    lowest = {key: low for key, _, low in near_brute(kept, 5, 80)}
    kept = [r for r in kept if lowest[r[0]] == r[0]]
    want = mixed_brute(kept)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    ids = {r: tuple(library.encode(r[1] or "", add_special_tokens=False).ids) for r in want}
    got = Counter((x["doc_id"], tuple(x["ids"])) for x in corpus_pipeline.run(spark, data).collect())
    expected: Counter = Counter()
    for r, n in want.items():
        expected[r[0], ids[r]] += n
    assert got == expected


def test_stages_on_awkward_and_empty_tables(spark, data):
    rows = [r for r in awkward() if r[0] is not None]
    extra = [F.lit(1).alias(c) for c in CLASHES]
    for docs in (spark.createDataFrame(awkward(), SCHEMA).select("*", *extra), spark.createDataFrame([], SCHEMA).select("*", *extra)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, data)
            assert name == "bpe" or made.columns == docs.columns, name
            out = made.collect()
            assert (not out) if not n else out, name
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, SCHEMA), data).collect()}
    assert kept == {r[0] for r in rows}


def test_run_on_an_empty_table(spark, data, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, data):
    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns, name
