import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from detectra.llm import exact, graph, lines, near, queries, substring, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_exact(spark, docs, texts):
    got = {r["doc_id"]: r for r in exact.groups(docs).collect()}
    by = defaultdict(list)
    for d, t in texts.items():
        by[(t or "").translate(LOW)].append(d)
    assert len(got) == len(texts)
    for t, ids in by.items():
        for d in ids:
            r = got[d]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), d == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    low = {r["doc_id"]: r["keep_id"] for r in exact.groups(docs, keep="smallest").collect()}
    assert all(low[d] == min(ids) for ids in by.values() for d in ids)


def test_exact_keeps_one_of_repeated_rows(odd, nothing):
    rows = exact.groups(odd).collect()
    same = [r for r in rows if r["doc_id"] == 5]
    assert [r["group_size"] for r in same] == [2, 2] and sum(r["kept"] for r in same) == 1
    assert {r["keep_id"] for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()} == {6}
    assert exact.groups(nothing).count() == 0


@pytest.mark.parametrize("hot", [substring.HOT, 1])
def test_substring(docs, texts, hot):
    length = 13
    first: dict = {}
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    got = {r["doc_id"]: r for r in substring.dedup(docs, length, hot).collect()}
    removed = 0
    for d, w in words.items():
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                hit[i : i + length] = [True] * length
        removed += sum(hit)
        assert (got[d]["n_words"], got[d]["n_removed"]) == (len(w), sum(hit))
        assert got[d]["kept_text"] == " ".join(x for x, h in zip(w, hit) if not h)
        s = got[d]["spans"]
        assert sum(b - a for a, b in zip(s[::2], s[1::2])) == sum(hit)
    assert removed > 500


def test_substring_edges(odd, nothing):
    rows = substring.dedup(odd, 3).collect()
    assert len(rows) == 5 and all(r["n_removed"] == 0 for r in rows)
    assert substring.dedup(nothing).count() == 0


def repeated_bytes(texts, length):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    hits = {}
    for d, b in raw.items():
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        hits[d] = hit
    return raw, hits


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix(docs, texts, hot):
    raw, hits = repeated_bytes(texts, 60)
    got = {r["doc_id"]: r for r in suffix.dedup(docs, 60, hot).collect()}
    assert sum(map(sum, hits.values())) > 5000
    for d, b in raw.items():
        assert bytes(got[d]["kept"]) == bytes(x for x, h in zip(b, hits[d]) if not h)
        assert got[d]["n_removed"] == sum(hits[d]) and got[d]["n_bytes"] == len(b)
        assert len(got[d]["spans"]) // 2 == len(re.findall(b"\1+", bytes(hits[d])))


def test_suffix_edges(odd, nothing):
    rows = suffix.dedup(odd, 10).collect()
    assert sum(r["n_removed"] > 0 for r in rows) == 2 and len(rows) == 5
    assert suffix.dedup(nothing).count() == 0


def test_interval_tree_lists_all_maximal_repeats():
    r = np.random.default_rng(0)
    for _ in range(30):
        texts = ["".join(r.choice(list("ab"), r.integers(0, 14))) for _ in range(3)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.cumsum([0, *map(len, texts)])
        array, groups = suffix.maximal_repeats(data, off, 2)
        got = sorted((n, tuple(sorted(array[a : b + 1].tolist()))) for a, b, n in groups)
        want = set()
        places = defaultdict(set)
        for t, o in zip(texts, off):
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    places[t[i:j]].add(int(o) + i)
        starts, ends = set(off[:-1].tolist()), set(off[1:].tolist())
        whole = "".join(texts)
        for s, at in places.items():
            left = [whole[p - 1] if p not in starts else None for p in at]
            right = [whole[p + len(s)] if p + len(s) not in ends else None for p in at]
            if len(at) > 1 and (None in left or len(set(left)) > 1) and (None in right or len(set(right)) > 1):
                want.add((len(s), tuple(sorted(at))))
        assert set(got) == want and len(got) == len(want)


def near_components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    groups = Sets()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return sets, groups


@pytest.mark.parametrize("k", [2, 5])
def test_near(docs, texts, k):
    sets, groups = near_components(texts, k, 80)
    got = {r["doc_id"]: r for r in near.find(docs, k, 80).collect()}
    assert len(got) == len(texts)
    for d in texts:
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (len(sets[d]), groups.find(d), groups.find(d) == d)
    assert sum(r["kept"] for r in got.values()) < len(got) - 10


def test_links_across_a_chain_of_edits(spark):
    """A group in which most pairs are not similar, so that stars leave links to find."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 20):
            w[(7 * j + i) % 120] = f"e{i % 7}_{j}"
        rows.append((i, " ".join(w)))
    _, groups = near_components(dict(rows), 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in near.find(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {d: groups.find(d) for d, _ in rows}


def test_near_edges(odd, nothing):
    rows = near.find(odd, 5, 80).collect()
    assert len(rows) == 5 and [r["component_id"] for r in rows if r["doc_id"] == 6] == [6]
    assert all(r["component_id"] == 5 and r["kept"] for r in rows if r["doc_id"] == 5)
    assert near.find(nothing).count() == 0


def test_least_matches_bound_the_miss_probability():
    need = near.least_matches(0.8, 5, 1e-9)
    r = np.random.default_rng(0).random((20000, 160)) < 0.8
    assert all((r[:, : 32 * (i + 1)].sum(1) >= m).all() for i, m in enumerate(need))
    assert need[-1] > 0.5 * 160


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    groups = Sets()
    for a, b in edges:
        groups.join(a, b)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == groups.find(n) for e in edges for n in e)


def line_components(texts, least=20):
    places = defaultdict(list)
    for d in sorted(texts):
        for n, line in enumerate((texts[d] or "").encode().split(b"\n")):
            if len(line) >= least:
                places[line].append((d, n))
    known = list(places)
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in known]
    groups = Sets()
    for i in range(len(known)):
        groups.find(i)
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                groups.join(i, j)
    out = defaultdict(list)
    for i, x in enumerate(known):
        out[groups.find(i)] += places[x]
    return {p for v in out.values() for p in sorted(v)[1:]}


def test_lines(docs, texts):
    gone = line_components(texts)
    rows = lines.dedup(docs, carry=True).collect()
    assert len(rows) == len(texts) and len(gone) > 20
    for r in rows:
        t = texts[r["doc_id"]]
        assert set(r["removed"]) == {n for d, n in gone if d == r["doc_id"]}
        if t is None:
            assert r["kept_text"] is None and r["n_lines"] == 0
        else:
            assert r["kept_text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in r["removed"])
        assert r["rest"]["rest"] == 7 and r["rest"]["doc_id"] == r["doc_id"]


def test_short_lines_as_registered(spark, tmp_path):
    rows = [(i, f"Page 1\n\n \nunlike line number {i * 7919} {'abcdefgh'[i % 8] * 20}\nfooter line 12\nPage 1\n{i}x") for i in range(40)]
    spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert len(out) == 40 and all(r["n_lines"] == 7 for r in out.values())
    assert {d: r["n_removed"] for d, r in out.items()} == {d: 1 if d == 0 else 3 for d in range(40)}
    stage = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()
    assert sum(r["text"].split("\n").count("Page 1") for r in stage) == 1 and all(r["text"].split("\n")[-1] == f"{r['doc_id']}x" for r in stage)


def test_line_edges(odd, nothing):
    rows = lines.dedup(odd).collect()
    assert len(rows) == 5 and sum(r["n_removed"] for r in rows) == 1
    assert lines.dedup(nothing).count() == 0


def thue_morse(n, swap=False):
    """A string and, swapped, its complement, which sums of powers modulo 2**64 can't tell apart."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_strings_that_sums_of_powers_confuse(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    w = " ".join(f"w{i}" for i in range(12))
    assert {r["component_id"] for r in near.find(frame([(1, a), (2, b)]), 2).collect()} == {1, 2}
    assert [r["n_removed"] for r in substring.dedup(frame([(1, f"{w} {a}"), (2, f"{w} {b}")])).collect()] == [0, 0]
    _, hits = repeated_bytes({1: a, 2: b}, 400)
    assert {r["doc_id"]: r["n_removed"] for r in suffix.dedup(frame([(1, a), (2, b)]), 400).collect()} == {d: sum(h) for d, h in hits.items()}
    # As lines the two have the same shingles of eight bytes, so they are near copies; with unlike ends they are still no equal lines.
    assert lines.line_digests([a.encode(), b.encode()]).tolist()[0] != lines.line_digests([b.encode()]).tolist()[0]
    assert len(lines.true_set(a.encode())) == len({a[i : i + 8] for i in range(1017)}) and (lines.true_set(a.encode()) == lines.true_set(b.encode())).all()


def test_very_long_words_and_texts(spark):
    word = "xyz" * 400_000
    rows = [(1, f"{word} one two three"), (2, f"{word} one two three"), (3, f"{word}q one two three"), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near.find(df, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup(df, 3).collect()} == {1: 0, 2: 4, 3: 3, 4: 0}
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup(df, whole=True).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert {r["doc_id"]: r["group_size"] for r in exact.groups(df).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}


def test_near_keep_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c d e f g", 1), (None, "a b c d e f g", 2), (None, "h i j k l m n", 3), (None, None, 4), (7, text, 5), (7, text, 6), (8, text + " end", 7), (9, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = near.keep(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted([(0, "a b c d e f g"), (0, "h i j k l m n"), (0, ""), (7, text), (9, "")])


def test_exact_copies_of_one_text_are_dealt_over_salts(spark):
    rows = [(i, "Hot text" if i % 3 else f"text {i}") for i in range(3000)]
    df = exact.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.collect()}
    hot = [i for i, t in rows if t == "Hot text"]
    assert len(got) == 3000 and {(got[i]["keep_id"], got[i]["group_size"]) for i in hot} == {(max(hot), len(hot))}
    assert [i for i in hot if got[i]["kept"]] == [max(hot)] and all(got[i]["kept"] and got[i]["group_size"] == 1 for i in range(0, 3000, 3))
    assert "salt" in df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_no_id_fills_a_chunk(spark):
    from collections import Counter

    from detectra.llm import wire

    schema = "doc_id long, text string"
    for third in ([(None, f"text {i} of many") for i in range(1000)], [(7, f"text {i} of many") for i in range(1000)], [(None, None)] * 1000):
        rows = third + [(i, f"document {i}") for i in range(1000, 3000)]
        docs = spark.createDataFrame(rows, schema).repartition(2)
        sizes = Counter()
        for r in wire.chunked(docs, 64).collect():
            sizes[r["chunk"]] += wire.unseal(r["body"]).num_rows
        assert sum(sizes.values()) == 3000
        assert max(sizes.values()) < 2 * 3000 / 64
        by_id = Counter()
        for r in wire.chunked(docs, 64, by_id=True).collect():
            by_id[r["chunk"]] += wire.unseal(r["body"]).num_rows
        assert max(by_id.values()) < 2 * 3000 / 64
