import os
import random
import time

import pytest

from labtables.llm import ngram_join as j


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))


def brute(rows):
    """Components by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k is None, k, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(draw.choice(words) for _ in range(12))
    rows = []
    for g in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.choice([1, 1, 2, 9, 25])):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            if draw.random() < 0.3:
                text.append(line)
            if draw.random() < 0.2:
                text = [w.upper() for w in text]
            rows.append(draw.choice([" ", "\n", "\t "]).join(text))
    rows += ["", None, " \n", "a b", "A  B", "one two three four five", "ÀB c", "àb c"]
    ids = draw.sample(range(10 * len(rows)), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spanning_links_give_the_components(seed):
    rows = [(k, t) for k, t in corpus(seed) if plain_set(t)]
    sets = j.shingle_sets([t.encode() for _, t in rows])
    assert [len(s) for s in sets] == [len(plain_set(t)) for _, t in rows]
    links = j.spanning_links(sets)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert 100 * len(plain_set(rows[a][1]) & plain_set(rows[b][1])) >= 80 * len(plain_set(rows[a][1]) | plain_set(rows[b][1]))
        assert find(a) != find(b)
        root[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    assert sorted(((False, k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows)), key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(12))
def test_prefixes_connect_what_links(seed):
    """Sets that link are connected by their prefixes too, whatever the order of tokens."""
    sets = [s for s in j.shingle_sets([(t or "").encode() for _, t in corpus(seed)]) if len(s)]
    sizes = [len(s) for s in sets]
    prefixes = [s[: j.prefix_length(len(s))] for s in sets]
    links = j.spanning_links(prefixes, sizes=sizes, ends=[int(p[-1] >> 40) for p in prefixes])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in j.spanning_links(sets))


def test_rounds_have_small_plans(spark, monkeypatch):
    """A round of stars joins three times; with unions of what it had joined it did six times."""
    joins, write = [], j.written

    def seen(df, what):
        if what == "stars":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, what)

    monkeypatch.setattr(j, "written", seen)
    links = [(k, k + 1) for k in range(40)] + [(60, 50), (70, 60), (80, 80)]
    got = sorted(map(tuple, j.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == [(k, 0) for k in range(1, 41)] + [(60, 50), (70, 50)]
    assert len(joins) > 2 and max(joins) <= 3


def test_stars():
    assert sorted(j.stars(6, [(0, 1), (2, 1), (4, 5)], [30, 20, 10, 5, 7, 9])) == [(9, 7), (20, 10), (30, 10)]


def test_search_and_merge():
    assert list(j.merge_skip([[1, 3, 5], [1, 5, 9], [2, 5]], 2)) == [(1, 2), (5, 3)]
    assert list(j.merge_skip([[1], [1]], 3)) == []
    draw = random.Random(9)
    for _ in range(200):
        lists = [sorted(draw.sample(range(30), draw.randint(1, 12))) for _ in range(draw.randint(1, 9))]
        least = draw.randint(1, 5)
        want = [(x, c) for x in range(30) if (c := sum(x in y for y in lists)) >= least]
        assert list(j.merge_skip(lists, least)) == want


@pytest.mark.parametrize("seed,chunk,heavy,whole", [(4, 2_000_000, 17, 512), (5, 150, 17, 512), (6, 2_000_000, 1, 512), (7, 400, 17, 512), (8, 2_000_000, 17, 3)])
def test_components_as_all_pairs(spark, monkeypatch, seed, chunk, heavy, whole):
    monkeypatch.setattr(j, "HEAVY_CLASS", heavy)
    monkeypatch.setattr(j, "WHOLE_NODES", whole)
    monkeypatch.setattr(j, "CHUNK_ROOTS", 8 if whole > 3 else 1)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_components(df, chunk=chunk).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from all of them at once"
    rows = [(5, long, "a"), (3, long.upper(), "b"), (9, "other text of some five words", "c"), (9, "other text of some five words", "c"), (7, None, "d"), (8, "", "e"), (None, "no id here at all now", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id or -1, r.source) for r in j.near_duplicates_removed(df).collect()) == [(-1, "f"), (3, "b"), (7, "d"), (8, "e"), (9, "c")]
    assert j.near_duplicates_removed(df.limit(0)).count() == 0
    assert j.ngram_components(df.limit(0)).count() == 0


def test_sizes_that_link_have_a_class_in_common():
    for n in range(1, 700):
        for m in range(n, n * 5 // 4 + 1):
            assert set(j.size_classes(n)) & set(j.size_classes(m)), (n, m)
    assert len(j.size_classes(300)) == len(j.size_classes(5000)) == 1


def test_null_and_repeated_ids(spark):
    """Many rows without an id, equal ids of different texts, the largest id, and a map column."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    rows = [(None, f"{'a b c d e f g'} {i % 40} tail", {"s": i}) for i in range(120)] + [(None, base, {"s": 1})] * 5 + [(2**63 - 1, near, {"s": 2}), (2**63 - 1, near, {"s": 1}), (7, "one two three four five six", {"s": 3}), (7, "other words of the same id here", {"s": 4}), (7, "other words of the same id here", {"s": 4})]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k map<string,int>").repartition(4)
    got = j.ngram_components(df).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.n_shingles == 56} == {2**63 - 1}
    assert {r.component_id for r in got if r.doc_id == 7} == {7} and {r.component_id for r in got if r.doc_id is None and r.n_shingles == 5} == {None}
    kept = sorted(((r.doc_id or 0, r.text, r["__k"]["s"]) for r in j.near_duplicates_removed(df).collect()))
    assert [x for x in kept if x[0]] == [(7, "one two three four five six", 3), (7, "other words of the same id here", 4), (2**63 - 1, near, 1)]
    # seven shared words and a number: sets of five shingles, of which four of six at least are shared
    assert len({x[1] for x in kept if not x[0]}) == len([x for x in kept if not x[0]])


def test_a_compilation_meets_no_quoted_text(spark):
    """A text that quotes many short ones links with none of them, and shares no block with them."""
    short = [" ".join(f"t{i}_{k}" for k in range(20)) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(short)] + [(1000, " ".join(short)), (1001, " ".join(short) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in j.ngram_components(df).collect()}
    assert got == {i: i for i in range(300)} | {1000: 1000, 1001: 1000}


def test_disk_follows_what_is_still_read(spark, monkeypatch):
    """Too many documents of groups for a broadcast: their texts cross compressed, sets don't, and tables
    and shuffle files that nothing reads any more are gone."""
    tables, write = {}, j.written

    def seen(df, what):
        out = write(df, what)
        tables.setdefault(what, []).append(out.written_at)
        return out

    sent, search = [], j._search
    monkeypatch.setattr(j, "written", seen)
    monkeypatch.setattr(j, "_search", lambda rows, *more: sent.append(dict(rows.dtypes)) or search(rows, *more))
    monkeypatch.setattr(j, "BROADCAST_BYTES", 0)
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    write(spark.range(1000).repartition(7, "id"), "dealt")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    rows = corpus(11)
    df = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_components(df).collect()), key=str)
    assert got == brute(rows + rows[:9])
    assert [x["text"] for x in sent if "text" in x] and not [x for x in sent if "tokens" in x and "stop" not in x]
    exists = lambda path: os.path.exists(path.removeprefix("file:").replace("//", "/"))
    assert exists(tables["nodes"][0]) and not [x for what in ("tokens", "shared") for x in tables[what] if exists(x)]
