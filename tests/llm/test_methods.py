"""Each operator against a plain computation on small tables."""

import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import nasty
from framewise.llm import bpe_dp, cdc, components, line_rules, packing, quality_cnn, sharding, simhash, suffix_dedup, token_counts, url_classes
from framewise.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    return nasty.table(spark).cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def as_ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


# 1: chunk fingerprints


def test_gear_hash_is_a_sum_over_32_bytes():
    data = random.Random(3).randbytes(200)
    got = cdc.gear_hashes(np.frombuffer(data, np.uint8))
    h = 0
    for i, b in enumerate(data):
        h = (2 * h + int(cdc.GEAR[b])) & 0xFFFFFFFF
        assert int(got[i]) == h


def test_chunks_cover_and_shift():
    text = nasty.prose(4000, 11).encode()
    ends = cdc.chunk_ends(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= cdc.MAX_SIZE and sizes[:-1].min() >= cdc.MIN_SIZE
    assert 40 < sizes.mean() < 90
    whole, moved = cdc.chunk_digests(text), cdc.chunk_digests(b"a few bytes more " + text)
    assert cdc.containment(whole, moved) > 0.99
    assert cdc.decode(cdc.encode(whole)) == whole


def test_slices_do_not_change_chunks(monkeypatch):
    text = nasty.prose(6000, 12).encode()
    want = cdc.chunk_ends(text)
    monkeypatch.setattr(cdc, "SLICE", 1000)
    assert cdc.chunk_ends(text) == want


@pytest.mark.parametrize("range_bytes", [3000, 1 << 30])
def test_edited_pairs(spark, awkward, range_bytes):
    rows = sorted(((-(2**63) if i is None else i), t or "") for i, t, *_ in nasty.rows())
    want = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + other[:n]
        fp, fe, fo = (cdc.chunk_digests(x.encode()) for x in (t, edited, other))
        want.append((None if i == -(2**63) else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), cdc.encode(fp), cdc.encode(fe), cdc.containment(fp, fe), cdc.containment(fp, fo)))
    got = [tuple(r) for r in cdc.edited_pairs(awkward, range_bytes=range_bytes).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# 2, 9, 10: tokens

ODD = "ab '\"\n\t  ,.!#123½²éßüİΣσς\x1c\x1d\x85\xa0 　漢字かな🙂́"


def odd_texts():
    r = random.Random(5)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return made + ["", "don't I'LL we've", "  a", "a  b   c \n d", "aaaa" * 300, "a<|endoftext|> b <|startoftext|>", "ΑΣ ΣΑ Σ", "x\n\n y\n \nz"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name, docs):
    raw = bpe_dp.read_vocabulary(vocabulary(name))
    library = Tokenizer.from_str(raw.decode())
    texts = odd_texts() + [r.text for r in docs.limit(120).collect()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    if name.startswith("word"):
        own = bpe_dp.PrefixBpe(raw)
        assert [own.decode(own.encode(t)) for t in texts] == [library.decode(i, skip_special_tokens=False) for i in want]
    else:
        own = token_counts.worker_encoder(raw)
    assert [as_ids(own.encode(t)) for t in texts] == want


def test_prefix_tokens_are_those_of_plain_merging():
    own = bpe_dp.worker_bpe(bpe_dp.read_vocabulary(vocabulary("word_bpe_49k.json")))
    for word in ("hello", "aaaaaaaa", "internationalisation", "zzxqj", "thethethe"):
        symbols = word[:-1] + chr(ord(word[-1]) + 256)
        last = own.last_tokens(symbols)
        ids = {own._symbols(t): i for i, t in own.shown.items() if i not in own.special.values()}
        for n in range(1, len(symbols) + 1):
            parts = [ids[c] for c in symbols[:n]]
            while True:  # the lowest-ranked pair, leftmost first
                ranked = [(own.rule[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in own.rule]
                if not ranked:
                    break
                _, k = min(ranked)
                pair = (parts[k], parts[k + 1])
                parts[k : k + 2] = [next(i for i, p in own.parts.items() if p == pair)]
            assert last[n] == parts[-1]


def test_counts(spark, awkward):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in nasty.rows())
    for table in (None, token_counts.LengthTable({}), token_counts.LengthTable({b" the": 1, b"a": 1})):
        got = token_counts.count_tokens(awkward, path, table=table).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_length_table():
    r = random.Random(1)
    lengths = {r.randbytes(r.randint(1, 6)): r.randint(1, 9) for _ in range(3000)}
    table = token_counts.LengthTable(lengths)
    assert all(table.get(k) == n for k, n in lengths.items())
    assert table.get(b"not there at all") == -1


def test_packing(spark, awkward):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(awkward, path).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 and len(p.ids) == 4 * p.length for p in pieces)
    streams, current = [], []
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        if p.start == 0:
            current = []
            streams.append((str(p.doc_id), current))
        assert p.start == len(current)
        current.extend(as_ids(p.ids))
        assert p.length * 2 > p.doc_tokens - p.start or p.length == 2048
    want = [(str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in nasty.rows()]
    assert sorted(streams) == sorted(want)


# 3: repeated passages


def brute_runs(rows, n=50):
    """Words of each document covered by a run of n words that another document has; and those of first occurrences."""
    distinct = sorted({(-math.inf if i is None else i, t or "") for i, t in rows})
    where = {}
    for d, (_, t) in enumerate(distinct):
        words = WORD.findall(t)
        for s in range(len(words) - n + 1):
            where.setdefault(tuple(words[s : s + n]), set()).add(d)
    covered = {}
    for d, (i, t) in enumerate(distinct):
        words = WORD.findall(t)
        for s in range(len(words) - n + 1):
            if len(where[tuple(words[s : s + n])]) > 1:
                covered.setdefault((i, t), set()).update(range(s, s + n))
    return covered


def check_passages(spark, rows):
    data = [(i, t, "en", "s", 0) for i, t in rows]
    df = spark.createDataFrame(data, nasty.SCHEMA).repartition(3)
    want = {}
    for (i, _), words in brute_runs(rows).items():
        want.setdefault(str(None if i == -math.inf else i), set()).update(words)
    got = {}
    for r in suffix_dedup.passages(df).collect():
        got.setdefault(str(r.doc_id), set()).update(range(r.first_word, r.until_word))
    assert got == want
    return df


def test_passages_on_awkward_rows(spark):
    check_passages(spark, [(i, t) for i, t, *_ in nasty.rows() if i != 8])


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_every_length(spark, seed):
    r = random.Random(seed)
    shared = [nasty.prose(r.randint(44, 75), 100 + seed * 50 + k) for k in range(12)]
    rows = []
    for d in range(30):
        parts = [nasty.prose(r.randint(0, 60), 1000 + seed * 100 + d)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), nasty.prose(r.randint(1, 40), r.randint(5000, 10**6))]
        rows.append((d, " ".join(parts)))
    df = check_passages(spark, rows)
    left = [(x.doc_id, x.text) for x in suffix_dedup.cut_repeats(df).collect()]
    texts = [t for _, t in left]
    once = {tuple(w) for t in map(WORD.findall, [t for _, t in rows]) for w in zip(*[t[k:] for k in range(50)])}
    # Every run that repeated is still there unless a part of it went with another first occurrence; none repeats whole.
    again = brute_runs(left)
    assert not again or all(len(v) <= 100 for v in again.values())
    untouched = {i for i, t in rows} - {i if i != -math.inf else None for (i, _) in brute_runs(rows)}
    assert all(dict(left)[i] == dict(rows)[i] for i in untouched) and len(once) and texts


@pytest.mark.parametrize("seed", range(3))
def test_parts_of_larger_copies(spark, seed):
    """Whole copies beside documents that share only a stretch of them, cut at any word."""
    r = random.Random(seed)
    bases = [nasty.prose(r.randint(150, 400), 700 + seed * 10 + k).replace("\n", " ") for k in range(3)]
    rows = [(k, t) for k, t in enumerate([*bases, *bases, bases[0].replace("a", "e", 2)])]
    for d in range(40):
        words = r.choice(bases).split(" ")
        at, n = r.randrange(len(words) - 50), r.randint(48, 90)
        rows.append((100 + d, " ".join([nasty.prose(r.randint(0, 40), 900 + d), *words[at : at + n], nasty.prose(r.randint(0, 40), 950 + d)])))
    check_passages(spark, rows)


def test_first_occurrence_is_kept(spark):
    passage = nasty.prose(70, 1)
    df = nasty.plain(spark, [nasty.prose(60, 2) + " " + passage, passage + " " + nasty.prose(60, 3), passage])
    left = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(df).collect()}
    assert passage in left[0] and left[1].strip() == nasty.prose(60, 3) and 2 not in left


# 4: quality


def test_gradients_are_slopes():
    r = np.random.default_rng(0)
    model = quality_cnn.ByteCnn()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    chunks, owner = r.integers(0, 256, (6, 64)).astype(np.uint8), np.array([0, 0, 1, 2, 2, 2])
    target, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, grad = model.step(chunks, owner, target, weight)
    for name, g in grad.items():
        at = tuple(r.integers(0, s) for s in g.shape)
        if name == "emb":
            at = (int(chunks[0, 5]), 1)
        h, old = 1e-5, model.w[name][at]
        model.w[name][at] = old + h
        up = model.step(chunks, owner, target, weight)[0]
        model.w[name][at] = old - h
        down = model.step(chunks, owner, target, weight)[0]
        model.w[name][at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 2e-3, name


def test_chunks_cover_all_bytes():
    model = quality_cnn.ByteCnn()
    for n in (0, 1, 255, 256, 257, 1000, 65536, 65537, 70001, 140000):
        data = random.Random(n).randbytes(n)
        raw = np.frombuffer(data.ljust(quality_cnn.CHUNK, b"\0"), np.uint8)
        plain = np.ascontiguousarray(quality_cnn._windows(model.w["emb"][np.append(raw, np.zeros(len(raw) % 2, np.uint8))])) @ model.w["conv"]
        got = model.chunk_responses(data)
        assert np.allclose(got.max(axis=0), np.maximum(plain.max(axis=0) + model.w["bias"], 0), atol=1e-4)
        assert len(got) == max(1, math.ceil((len(plain)) / 64) - 1)


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_cnn.fit(docs, labels)
    scores = {r.doc_id: r.score for r in quality_cnn.score(docs, model).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.93


def test_one_class_gives_the_share():
    assert quality_cnn.train([]).score("x") == 0.5
    assert quality_cnn.train([(b"a", 1), (b"b", 1)]).score("") == 0.75


# 5: SimHash


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_fingerprint_and_components(spark, docs, awkward):
    for text in [t or "" for _, t, *_ in nasty.rows() if len(t or "") < 5000]:
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    roots = brute_groups([simhash.fingerprint(t) % (1 << 64) for _, t in rows])
    want = {rows[i][0]: rows[root][0] for i, root in enumerate(roots)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("hot", [5, 200_000, 6])
def test_links_equal_all_pairs(spark, hot):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(25)]
    values = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(r.choice([1, 5, 120])):
            v = c
            for _ in range(r.randint(0, 5)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), hot_file=hot)
    assert all(((a ^ b) & ((1 << 64) - 1)) for a, b in links.collect())
    root = {r.node: r.root for r in components.components(links).collect()}
    got = [root.get(s, s) for (s,) in signed]
    groups = brute_groups(values)
    assert len(set(zip(got, groups))) == len(set(got)) == len(set(groups))


def test_index_drops_far_groups():
    codes = np.sort(np.array([random.Random(1).getrandbits(64) for _ in range(500)], np.uint64))
    ranks = codes.copy()
    index = simhash.GrayIndex(np.zeros(500, np.int64), ranks ^ (ranks >> np.uint64(1)))
    assert (index.link(3) == np.arange(500)).all()
    assert len(index.levels) == 9 and len(index.levels[0]) == 1


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100} | {201 + i: 200 for i in range(50)}


# 6: line rules


def brute_counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counted = {}
    for w in windows:
        counted[w] = counted.get(w, 0) + 1
    under = {i + k for i, w in enumerate(windows) if counted[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(under) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(under), failed


def test_base_counts(spark, docs, awkward):
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (awkward, [(i, t) for i, t, *_ in nasty.rows()])):
        got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in line_rules.judge(df).collect())
        assert got == sorted((str(i), *brute_counts(t or "")) for i, t in rows)


def test_lines(spark):
    good = "This is a plain line of words that ends well."
    lines = {
        good: True, "Home | News | Sport | Weather | Video.": False, "BUY!! NOW!! CHEAP!! OFFERS!!": False, "a### b*** c$$$ d%%%.": False,
        "one two three four five six seven": False, "Read our privacy policy.": False, "See you": True, "  ": True,
    }
    text = "\n".join([*lines, *[nasty.prose(9, 40 + i) for i in range(9)]])
    out = line_rules.judge(nasty.plain(spark, [text, "\n".join([good, *["x| y| z| u| v."] * 9])])).orderBy("doc_id").collect()
    assert out[0].kept and out[0].clean_text.split("\n")[: 3] == [good, "See you", "  "]
    assert not out[1].kept and out[1].lost_share > 0.5


# 7: URL classes


def test_redirect_classes(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    meta = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.example.com/en/70", None, "example.com/en/7", "allow"), (2, "http://A.Example.com/en/9?x=1", None, "com/en/", "block"),
        (3, "https://alias.info/x", link.format("http://a.example.com/en/9?x=1"), None, "block"),
        (4, "https://other.info/y#f", meta.format("//alias.info/x"), None, "block"),
        (5, "http://third.info/z", link.format("/w/"), None, "allow"), (6, "https://www.third.info/w?utm_source=q", meta.format("http://b.example.com/en/71"), None, "allow"),
        (7, "http://mixed.info/", link.format("http://x.org/es/1"), None, "allow"), (8, "http://mixed.info?ref=1", link.format("https://a.example.com/en/7"), None, "allow"),
        (9, "http://free.info/", link.format("mailto:x@y.z"), None, "allow"), (10, "http://example.net/de/81", "", "example.net/de/8", "block"),
        (11, "http://notexample.net/de/81", "", "net/de/", "block"), (12, "ftp://com/en/?q", "", "com/en/", "block"), (13, "http://example.com/de/en/", "", None, "allow"),
    ]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_classes.judge(df).collect()}
    assert got == {p[0]: p[3:] for p in pages}
    seen = spark.createDataFrame([("http://free.info", "http://q.example.net/de/1")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_classes.judge(df, seen).collect()}[9] == "block"


# 8: sharding


@pytest.mark.parametrize("n", [1, 8])
def test_shards(spark, docs, n):
    rows = sharding.shard(docs, n).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    total = sum(r.size for r in rows)
    for s in range(n):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= max(r.size for r in rows)


def test_hot_text_is_subdivided(spark):
    df = nasty.plain(spark, ["copy " * 20] * 700 + [nasty.prose(20, k) for k in range(300)])
    rows = sharding.shard(df, 8, ranges=64).collect()
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.1 * sum(sizes) / 8


def test_native_plans_run_no_python(spark, docs):
    for df in (line_rules.judge(docs), line_rules.clean(docs), sharding.shard(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_hot_files_are_split_until_they_are_not(spark):
    """Fingerprints that agree on 40 bits: two splits do not part them."""
    r = random.Random(31)
    head = r.getrandbits(40) << 24
    values = sorted({head | r.getrandbits(24) for _ in range(3000)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    files = simhash._files(fps, 150)
    sizes = [row["count"] for row in files.groupBy("file").count().collect()]
    assert max(sizes) <= 150
    links = simhash.links(fps, hot_file=150)
    root = {row.node: row.root for row in components.components(links).collect()}
    got, groups = [root.get(s, s) for (s,) in signed], brute_groups(values)
    assert len(set(zip(got, groups))) == len(set(got)) == len(set(groups))
