"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyrill.llm import ann, components, licenses, lines, packing, quality, sharding, simhash, suffixes, tokens, winnowing
from tallyrill.llm._shared import small_batches

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, raw string, zip string, spans string, part int, block string, doc long, dk long, key long, line string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "Thére", "onthe", "rea", "ing", "stou", "wh", "éau", "zzq"]) + rng.choice(["", "", "nd", "er", ".", ",", "\n"]) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = prose(rng, 150)
    near = base.replace("stou", "Stou", 1)
    passage = prose(rng, 40)
    out = [None, "", "  \n \n", "a", "one two", base, base, near, base + "!", "x" * 700, "ab" * 300, prose(rng, 6000)]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(12)]
    out += [prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20) for _ in range(6)]
    out += ["MIT License\r\n\r\nCopyright (c) 2020 Somebody\n\n" + licenses.KNOWN["MIT"][0].upper(), "Some words.\nReleased under the MIT Licence!\nMore.", "<|endoftext|> Οδός ΣΑΣ \x1c ½ don't  ''   x\t\r\n y", "日本語の文字列 " * 30]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    more = (0, "h", "raw", "zip", "spans", 1, "block", 7, 8, 9, "line")
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", 5, *more) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, an id with two texts, and rows that repeat in full."""
    long = "the same words again and again, " * 8
    more = ("en", None, 1, 0, "h", "raw", "zip", "spans", 1, "block", 7, 8, 9, "line")
    return spark.createDataFrame([(i, t, *more) for i, t in [(None, long), (None, None), (1, long), (1, long), (1, "other"), (2, long)]], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_no_column_is_hidden(spark):
    """Columns named as what the operators use inside come out as they went in, from all that carry columns."""
    names = ["__h", "__id", "__k", "__r", "__raw", "__dk", "__gone", "__key", "__host", "__path", "__q", "__t", "__keep", "__doc", "__zip", "__fp", "___h"]
    text = "some words that are no copy of anything else here, and go on for quite a while to be long enough, "
    rows = [(i, text * 2 if i < 2 else f"{i} other words {i * 7} and {i * 31} more of them {i * 101}", "en", "a/b", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"{n} string" for n in names)]))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for kept in (lines.drop_repeated_lines(docs), simhash.keep_one(docs), simhash.keep_one_similar(docs), suffixes.remove_repeated(docs), quality.keep_good(docs, marks, most_toxic=1.0)):
        got = kept.collect()
        assert kept.columns == docs.columns and {r["doc_id"] for r in got} >= {0, 2, 3, 4, 5}
        assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


# Packing


def test_pack(docs, rows):
    t = Tokenizer.from_file(WORD)
    got = packing.pack_documents(docs, WORD, capacity=512).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    total = 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 512))
        for r in own:
            part = ids[r["start"] : r["start"] + 512]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= -(-total // 512) + 1


def test_pack_odd(none, odd):
    assert packing.pack_documents(none, WORD).collect() == []
    assert packing.pack_documents(odd, WORD).count() == 6


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1000, 2400, 3000)
    before = packing.best_fit(lengths, 4096)
    n = len(before)
    after = packing.local_search(lengths, [list(b) for b in before], 4096)
    assert len(after) < n and sorted(i for b in after for i in b) == list(range(3000))
    assert max(lengths[b].sum() for b in after) <= 4096


# Sharding


def test_shard(docs, rows):
    got = sharding.shard_by_size(docs, 4).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(rows)
    of = {r["doc_id"]: r["shard"] for r in got}
    same = defaultdict(set)
    for i, t in rows:
        same[t or ""].add(of[i])
    assert all(len(s) == 1 for s in same.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_odd(spark, none, odd):
    assert sharding.shard_by_size(none, 4).collect() == []
    got = sharding.shard_by_size(odd, 3).collect()
    assert len(got) == 6 and len({r["shard"] for r in got if r["size"] > 200}) == 1
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")).alias("text"))
    hot = many.unionAll(many.select("doc_id", F.lit("hot one").alias("text")))
    got = sharding.shard_by_size(hot, 8).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["m"] + 1 for r in got) and max(r["s"] for r in got) <= 1.01 * min(r["s"] for r in got)


def test_schedule():
    assert sharding.schedule([(0, 5), (1, 5), (2, 4), (3, 3), (4, 3)], 2) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}


# Suffixes


def removed(rows, length=100):
    """By every window's bytes, in order."""
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        covered = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - length + 1):
            w = raw[at : at + length]
            if w in seen:
                covered[at : at + length] = True
            seen.add(w)
        edges = np.diff(covered.astype(int), prepend=0)
        kept = bytes(b for b, c in zip(raw, covered, strict=False) if not c)
        out[i] = (len(raw), len(raw) - len(kept), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs, rows):
    got = {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in by_id(suffixes.digests(docs)).items()}
    assert got == removed(rows)


@pytest.mark.parametrize(("seed", "hot"), [(0, 1 << 15), (1, 1 << 15), (1, 3)])
def test_suffixes_of_few_letters(spark, seed, hot, monkeypatch):
    """Many surroundings of few suffixes: all ways to compare are used."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.choice([40, 70, 130]))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(30)) for _ in range(8))) for i in range(60)]
    got = by_id(suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == removed(rows)


def test_suffixes_odd(docs, none, odd):
    assert suffixes.digests(none).collect() == []
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in suffixes.digests(odd).collect() if r["n_bytes"] > 10)
    # Rows of equal id and text are one document.
    inside = removed([(1, "the same words again and again, " * 8)])[1][1]
    assert [g[2] for g in got] == [inside, inside, 256, 256]
    kept = suffixes.remove_repeated(docs)
    assert kept.columns == docs.columns and kept.filter("raw <> 'raw' or zip <> 'zip' or spans <> 'spans' or part <> 1 or doc <> 7 or dk <> 8").count() == 0


def test_merge():
    rng = random.Random(3)
    prefix = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    for _ in range(100):
        runs = []
        for _ in range(rng.randint(1, 9)):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 12)))
            runs.append((keys, [0, *(prefix(a, b) for a, b in zip(keys, keys[1:], strict=False))][: len(keys)]))
        order, shared, _ = suffixes.merge(runs)
        at, out = [0] * len(runs), []
        for r in order:
            out.append(runs[r][0][at[r]])
            at[r] += 1
        assert out == sorted(k for r in runs for k in r[0])
        assert shared == [0, *(prefix(a, b) for a, b in zip(out, out[1:], strict=False))][: len(out)]
    keys = np.array([list(b"abcd"), list(b"abce"), list(b"abce"), list(b"b\0\0\0")], np.uint8)
    shared, rests = suffixes.front_code(keys)
    assert shared.tolist() == [0, 3, 4, 0] and (suffixes.front_decode(shared, rests, 4) == keys).all()


# Winnowing


def chosen(text, k, window):
    codes = [ord(c) for c in text]
    if not codes:
        return set()
    k = min(k, len(codes))
    hashes = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * int(winnowing._BASE) + c + 1) % 2**64
        h = ((h ^ (h >> 33)) * int(winnowing._MIX)) % 2**64
        hashes.append((h ^ (h >> 29)) & 0xFFFFFFFF)
    window = min(window, len(hashes))
    out = set()
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        out.add((max(j for j in range(i, i + window) if hashes[j] == least), least))
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 40, 300])
def test_winnow(n, monkeypatch):
    monkeypatch.setattr(winnowing, "_BLOCK", 50)
    rng = random.Random(n)
    for k, window in ((1, 1), (3, 5), (8, 8), (13, 2)):
        text = "".join(rng.choice("abé") for _ in range(n))
        h, at = winnowing.winnow(text, k, window)
        assert set(zip(at.tolist(), h.tolist(), strict=True)) == chosen(text, k, window) and len(set(at.tolist())) == len(at)


def test_fingerprints(docs, rows, none, odd):
    got = by_id(winnowing.fingerprint_edits(docs, 8, 12))
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = ({h for _, h in chosen(x, 8, 12)} for x in (t, edited, u)) if len(t) < 3000 and len(u) < 3000 else (None, None, None)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if a is not None:
            like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            assert got[i]["fingerprint"] == "".join(f"{h:08x}" for h in sorted(a)) and got[i]["edited_fingerprint"] == "".join(f"{h:08x}" for h in sorted(b))
            assert got[i]["near_edited"] == pytest.approx(like(a, b)) and got[i]["near_next"] == pytest.approx(like(a, c))
    assert winnowing.fingerprint_edits(none).collect() == []
    assert winnowing.fingerprint_edits(odd).count() == 6
    assert winnowing.fingerprint_edits(docs.limit(1)).count() == 1
    assert winnowing.fingerprints(docs).count() == len(rows)


# Lines


def lines_gone(rows, k=8, similarity=0.8):
    found = [(i, n, x) for i, t in rows if t for n, line in enumerate(t.split("\n")) if (x := line.strip().lower())]
    names = sorted({f[2] for f in found})
    sets = [{x[j : j + k] for j in range(max(1, len(x) - k + 1))} for x in names]
    up = list(range(len(names)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    first, gone = {}, defaultdict(list)
    for i, n, x in sorted(found):
        r = root(names.index(x))
        if r in first:
            gone[i].append(n)
        first.setdefault(r, (i, n))
    return gone


def test_lines(docs, rows, none, odd):
    want = lines_gone(rows)
    got = by_id(lines.report(docs))
    assert {i: r["removed_lines"] for i, r in got.items()} == {i: ",".join(map(str, want[i])) for i, _ in rows}
    kept = lines.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) if t else t for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: t for i, t in left.items() if not want[i] or t.strip()}
    assert lines.report(none).collect() == [] and lines.drop_repeated_lines(none).collect() == []
    assert lines.report(odd).count() == 6


@pytest.mark.parametrize("part", [1 << 20, 4000])
def test_lines_of_large_groups(spark, part, monkeypatch):
    """Families of hundreds of copies, of which many are far from any one line: all links of lines that share a band count."""
    monkeypatch.setattr(lines, "PART", part)
    rng = random.Random(3)
    letter = lambda: rng.choice("abcdefghijklmnop")
    all_lines = []
    for _ in range(2):
        base = [letter() for _ in range(160)]
        for _ in range(100):
            variant = list(base)
            for at in rng.sample(range(160), rng.choice([1, 3, 4, 5])):
                variant[at] = letter().upper() + "#"
            all_lines.append("".join(variant))
            for _ in range(2):
                copy = list(variant)
                copy[rng.randrange(160)] = letter() + "!"
                all_lines.append("".join(copy))
    rng.shuffle(all_lines)
    sets = [lines.shingles(lines.normal(x), 8) for x in all_lines]
    signs = lines.signatures([lines.normal(x) for x in all_lines], 8, 12, 4)
    a, b = np.array([(i, j) for i in range(len(sets)) for j in range(i) if (signs[i] == signs[j]).any() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]).T
    root = components.local_roots(len(sets), a, b)
    got = lines.report(spark.createDataFrame(list(enumerate(all_lines)), "doc_id long, text string").repartition(3))
    assert {r["doc_id"] for r in got.collect() if r["n_removed"]} == set(np.flatnonzero(root != np.arange(len(root))).tolist())


def test_lines_of_one_template(spark):
    """Pairs at 0.81 that share a long template, and are 0.72 from all others."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, all_lines = word(250), []
    for _ in range(150):
        own = word(30)
        all_lines += [own + template + word(15), own + template + word(15)]
    rng.shuffle(all_lines)
    rows = list(enumerate(all_lines))
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = {i for i, gone in lines_gone(rows).items() if gone}
    found = {r["doc_id"] for r in got.collect() if r["n_removed"]}
    assert len(want) >= 140 and found <= want and len(found) >= 0.99 * len(want)


def test_line_signatures_agree():
    rng = random.Random(1)
    hits = tried = 0
    for _ in range(200):
        a = prose(rng, 30).replace("\n", " ")
        at = rng.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        s, t = lines.shingles(a, 8), lines.shingles(b, 8)
        if len(s & t) >= 0.8 * len(s | t):
            tried += 1
            x = lines.signatures([a, "short", b], 8, 12, 4)
            hits += bool((x[0] == x[2]).any())
    assert tried > 50 and hits >= 0.97 * tried


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: root(a) for a in up if root(a) != a}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_components_of_blocks(spark, monkeypatch, block):
    """Chains, hubs, repeated links, loops and nulls come out the same however few edges a task contracts, for bytes too."""
    monkeypatch.setattr(components, "BLOCK", block)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(201, 200), (201, 200), (300, 300), (None, 5), (7, None)]
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {r["node"]: r["root"] for r in components.components(frame).collect()} == want
    coded = frame.selectExpr("cast(lpad(a, 4, '0') as binary) a", "cast(lpad(b, 4, '0') as binary) b")
    assert {int(r["node"]): int(r["root"]) for r in components.components(coded).collect()} == want


# Tokens

HARD = ["don't  '' 'tis x'sab !!'sab a 'll  \n\n\ny \r\n z\t", "a\x1c b\xa0 c  d　 x", "\x85 a ​x﻿", "İstanbul é éx ́y", "!!\x1c\x1d b", "<|endoftext|><|startoftext|> a", "    a᠎b", "ſt ﬁ Ǆ ß ẞ", "a" * 5000, "٣٤ Ⅷ ² x²"]


@pytest.mark.parametrize(("kind", "path"), [(tokens.ForcedBoundaries, BYTE), (tokens.SpacedWords, WORD)])
def test_encoders(kind, path):
    t, e = Tokenizer.from_file(path), kind(path)
    rng = random.Random(4)
    odd = "".join(map(chr, [*range(32, 127), *range(160, 400), 0x301, 0x3A3, 0x2028, 9, 10, 13, 0x1C, 0x85, 0x3000, 0x4E00, 0x1F600]))
    cases = HARD + [x or "" for x in texts()] + ["".join(rng.choice(odd + " ' \n" * 40) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    got = e.encode([c.encode() for c in cases])
    for c, ids in zip(cases, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(c, add_special_tokens=False).ids, repr(c)
        if kind is tokens.ForcedBoundaries:
            assert e.decode(ids) == t.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False) == c


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    e = tokens.SpacedWords(WORD)
    assert e.encode([b"a b c d e", b"a b"])[1] == e.encode([b"a b"])[0] and len(e.cache) <= 5


def test_round_trip(docs, rows, none, odd):
    t = Tokenizer.from_file(BYTE)
    got = by_id(tokens.round_trip_digests(docs, BYTE))
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs, BYTE), BYTE).collect()} == {i: x or "" for i, x in rows}
    assert tokens.round_trip_digests(none, BYTE).collect() == [] and tokens.round_trip_digests(odd, BYTE).count() == 6


# SimHash


def simhashes(rows, width):
    out = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def reach(prints, radius):
    f = np.array(prints, np.uint64)
    near, label = np.bitwise_count(f[:, None] ^ f[None]) <= radius, np.arange(len(f))
    while (label != (new := np.where(near, label[None], len(f)).min(axis=1))).any():
        label = new
    return label


@pytest.mark.parametrize("hot", [False, True])
def test_simhash(docs, rows, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(simhash, "HOT_ROWS", 2)
        monkeypatch.setattr(simhash, "TILE", 3)
    prints = simhashes(rows, 4)
    label = reach(prints, 4)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", rows[n][0]) for (i, _), p, n in zip(rows, prints, label, strict=True)}


@pytest.mark.parametrize(("count", "hot"), [(400, 1 << 30), (400, 20), (1 << 40, 1 << 30)])
def test_links_are_complete(spark, count, hot, monkeypatch):
    """Random fingerprints with neighbours at all distances, for one block and for several that must agree."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {0, (1 << 64) - 1, *base}
    for b in base * 4:
        x = b
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    masks = simhash._masks(count, 4)
    monkeypatch.setattr(simhash, "_masks", lambda *_: masks)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, 4).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    at = {p: i for i, p in enumerate(prints)}
    mine = components.local_roots(len(prints), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
    assert (mine == reach(prints, 4)).all()


def test_simhash_odd(docs, rows, none, odd):
    assert simhash.near_duplicates(none).collect() == [] and simhash.near_duplicates(odd).count() == 6
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(odd).collect()) == ["1", "1", "None"]
    kept = simhash.keep_one(docs)
    label = reach(simhashes(rows, 4), 4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(rows[n][0] for n in set(label.tolist()))


@pytest.mark.parametrize("hot", [False, True])
def test_similar(spark, docs, none, odd, hot, monkeypatch):
    """An original with copies that are near it but not all near each other, and shorter and longer ones."""
    if hot:
        monkeypatch.setattr(simhash, "HOT_ROWS", 6)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(4):
        base = [word() for _ in range(400)]
        rows.append(base)
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(0, 400, 8), rng.choice([2, 6, 8, 14])):
                copy[at] = word()
            rows.append(copy)
        rows += [base[:300], base + base[:20], base]
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(900, None), (901, ""), (902, "a b"), (903, "a  B")]
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) or (t or "").lower() and {" ".join(t.lower().split())} or set() for _, t in ((i, t or "") for i, t in rows)]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if label[i] != label[j] and len(a & b) >= 0.8 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    want = sorted(rows[i][0] for i in set(label))
    got = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = sorted(r["doc_id"] for r in got.collect())
    assert got == want
    if not hot:
        assert simhash.keep_one_similar(none).collect() == [] and simhash.keep_one_similar(docs).columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in simhash.keep_one_similar(odd).collect()) == ["1", "1", "None"]


@pytest.mark.parametrize(("rows", "shingles"), [(1, 1 << 23), (1 << 15, 400)])
def test_similar_hot_groups_lose_no_pair(spark, rows, shingles, monkeypatch):
    """Pairs just over the similarity, of which every group is hot."""
    monkeypatch.setattr(simhash, "HOT_ROWS", rows)
    monkeypatch.setattr(simhash, "HOT_SHINGLES", shingles, raising=False)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(300):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(5, 295, 6), 6):
            copy[at] = word()
        texts += [base, copy]
    texts = [" ".join(t) for t in texts]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    prints = [simhash.fingerprint(x) for x in sets]
    linked = [len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1])) and (prints[i] ^ prints[i + 1]).bit_count() <= 20 for i in range(0, 600, 2)]
    assert sum(linked) > 290
    got = simhash.keep_one_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(600) if i % 2 == 0 or not linked[i // 2]]


def test_similar_whatever_repeats(spark):
    """Nearly equal sets of shingles, in texts that differ in how often one phrase repeats."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        words, phrase = [word() for _ in range(1000)], [word() for _ in range(10)]
        texts += [" ".join([first, *words] + phrase * times) for first, times in (("one", 3), ("other", 1000))]
    got = simhash.keep_one_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 24, 2))


# Neighbours


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) * rng.uniform(0.5, 2, size=(n, 1))


def test_ann(spark):
    x = vectors(1, 1500, 24).astype(np.float32)
    x[700:760] = x[40]  # copies, more than a result holds
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [None] * 24), (2100, [1.0] * 3), (None, [1.0] * 24), (2120, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("cid", F.lit(2))
    got = defaultdict(list)
    for r in ann.search(df, 20, 20, width=1, block=50, chunk=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    assert sorted(got) == list(range(0, 1500, 20))
    found = 0
    for q, rows_ in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert np.allclose([r[2] for r in rows_], s[[r[1] for r in rows_]])
        found += len({r[1] for r in rows_} & set(order.tolist()))
    assert found >= 0.9 * 20 * len(got)
    assert [r[1] for r in got[40]][:20] == list(range(700, 720))


def test_ann_whatever_the_rows(spark):
    """Tight groups larger than what is reranked first, one component that outweighs the others, lengths that differ, a mean far from
    zero, queries in a group that the fit does not see, numbers whose squares are out of range: the same rows as brute force."""
    rng = np.random.default_rng(8)
    n, d = 1200, 16
    g, middle = rng.normal(size=(n, d)), rng.normal(size=(3, d))
    cases = {"groups": middle[np.arange(n) % 3] + 1e-3 * g, "one": g * np.where(np.arange(d) == 3, 1000.0, 1.0), "lengths": g * np.exp(2 * rng.normal(size=(n, 1))), "offset": 1e4 + g, "huge": g * 1e152}
    cases["rare"] = np.where(np.arange(n)[:, None] % 20 < 2, 5 * middle[0] + 1e-3 * g, 0.1 * g)
    for name, x in cases.items():
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in ann.search(df, 20, 20, sample=200, rerank=30, width=1, chunk=500).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert sorted(got) == list(range(0, n, 20)), name
        for q, found in got.items():
            s = np.cumsum(x * x[q], axis=1)[:, -1]
            order = np.lexsort((np.arange(n), -s))
            order = order[order != q][:20]
            assert found == list(zip(order.tolist(), s[order].tolist())), (name, q)


def test_ann_repeated_ids(spark):
    """A query's id with several vectors, all nearer than any other row; a vector whose rows mostly repeat one id; another id with two."""
    rows = [(20, [10.0 + i, 0.0]) for i in range(5)] + [(40, [0.0, 9.0])] * 30 + [(i, [0.0, 9.0]) for i in (41, 42)] + [(i, [1.0, i / 100]) for i in range(1, 9)] + [(3, [0.5, 0.5])]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 9).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[20] == [(i, 10.0) for i in range(1, 9)] + [(3, 5.0)]
    assert got[40] == [(41, 81.0), (42, 81.0), (3, 4.5)] + [(i, 9 * (i / 100)) for i in (8, 7, 6, 5, 4, 3)]


def test_ann_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.search(spark.createDataFrame([], schema)).collect() == []
    assert ann.search(spark.createDataFrame([(20, [1.0, 2.0, 3.0])], schema)).collect() == []
    got = ann.search(spark.createDataFrame([(20, [1.0, 2.0, 3.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, -1.0])], schema)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, -3.0)]


def test_parallel_residual_is_less():
    x = vectors(3, 3000, 16)
    scored, plain = ann.fit(x, 2, 0.5), ann.fit(x, 2, 0.0)

    def parallel(q):
        r = x - np.concatenate([c[k] for c, k in zip(q.centres, q.codes(x).T, strict=True)], axis=1)
        return (((r * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert scored.eta > 1 and plain.eta == 1 and parallel(scored) < 0.8 * parallel(plain)


# Licences


def test_licenses(docs, none, odd):
    got = by_id(licenses.scan_documents(docs))
    whole = {i: r["license_id"] for i, r in got.items() if r["license_id"]}
    some = {i: r["line_licenses"] for i, r in got.items() if r["line_licenses"]}
    n = len(texts()) - 4
    assert whole == {3 * n: "MIT"} and some[3 * (n + 1)] == "MIT"
    assert licenses.scan_documents(none).collect() == [] and licenses.scan_documents(odd).count() == 6


def test_canonical(spark):
    pairs = [("The  LICENCE, licence; sub-license v2.", "the license license sublicense version 2"), ("Copyright (c) 2020 X\n  © Y\n\nFree. All Rights Reserved.", "free"), (None, ""), ("the copyright notice", "the copyright notice")]
    got = spark.createDataFrame([(a,) for a, _ in pairs], "t string").select(licenses.canonical(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in pairs]


# Quality


def test_evidence_blocks(spark):
    """Texts that are carried come back as they were, with the odds of each text by itself, over blocks and batches; the session's setting stays."""
    width = len(quality.shape(b"", [], 0)) + 2 * quality.TOP
    model = quality.Model([{}, {}], [np.zeros(width)] * 2, [np.ones(width)] * 2, [np.linspace(-1, 1, width + 1), np.linspace(1, -2, width + 1)])
    texts = [None, "", "é long text. " * 400_000, *(f"row {i} has\nA few words" for i in range(2500)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 1 << 16):
        whole = {r["doc_id"]: r for r in quality.evidence(docs, model, "doc_id", "text").collect()}
        alone = {r["doc_id"]: r for r in quality.evidence(docs, model, "doc_id").collect()}
    assert spark.conf.get(key) == before and len(whole) == len(alone) == len(texts)
    for i, text in enumerate(texts):
        odds = model.log_odds([(text or "").encode()])[0]
        assert whole[i]["text"] == text
        assert np.allclose([whole[i]["__q"], whole[i]["__t"]], odds) and np.allclose([alone[i]["__q"], alone[i]["__t"]], odds)


def test_quality(spark, none, odd):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        words = [rng.choice(["river", "stone", "green", "winter", "letter", "house"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 120))]
        if toxic:
            words[3:3] = rng.sample(["scoundrel", "villain", "wretch", "rascal"], 2)
        text = " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"host{i % 7}/p{i % 3}", 9))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
        rows[-1] = (*rows[-1], good and not toxic)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good boolean")
    marks = spark.createDataFrame(labels + [(None, 1, 0), (5000, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality.score(docs, marks))
    held_out = [r for r in rows if r[0] % 2 == 0]
    assert sum(got[r[0]]["keep"] == r[-1] for r in held_out) >= 0.97 * len(held_out)
    assert got[1]["host"] == "host1" and got[1]["path"] == "p1"
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}
    assert quality.score(none, marks).collect() == []
    assert quality.score(odd, marks.limit(0)).count() == 6


def test_sparse_sites_shrink(spark):
    """A site of one document stays near the mean; one of many goes where its documents are."""
    scored = spark.createDataFrame([("big", "a", 4.0, -4.0)] * 200 + [("other", "b", -4.0 if i % 3 else 4.0, -4.0) for i in range(300)] + [("tiny", "c", 4.0, -4.0)], "__host string, __path string, __q double, __t double")
    got = {r["__host"]: r for r in quality.sites(scored).collect()}
    mean = sum(r["__n"] * r["__path_quality"] for r in got.values()) / sum(r["__n"] for r in got.values())
    assert got["big"]["__path_quality"] > 0.95 and got["other"]["__path_quality"] < 0.45
    assert mean < got["tiny"]["__path_quality"] < got["big"]["__path_quality"] and got["tiny"]["__shift_quality"] < got["big"]["__shift_quality"]


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert len(left) == at.count() and {r["doc_id"] for r in out.collect()} == set(left)
    t = Tokenizer.from_file(WORD)
    sizes = Counter()
    for r in out.collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in left.items()}
