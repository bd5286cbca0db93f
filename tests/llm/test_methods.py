"""Operators against plain Python versions of what they must give."""

import random
import re
import unicodedata
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tidewright.llm import byte_bpe, fingerprints, jaccard_join, language, line_rules, packing, personal, resampling, sharding, word_ids

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(small):
    return pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_ranks(BYTES), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_codec():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTES), special_tokens={})


def test_bpe_equals_library(texts, codec, tiktoken_codec):
    for text in texts:
        assert codec.encode(text) == tiktoken_codec.encode_ordinary(text)


def test_bpe_on_random_strings(codec, tiktoken_codec):
    rnd = random.Random(3)
    parts = ["a", "b", " ", "é", "the", "ing", " in", "\n", "  ", "1", "--", "=", "漢", "🙂", "'s", "　", "\x1c", "\x85", "́", "ſ", "\xa0", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == tiktoken_codec.encode_ordinary(text)
        assert "".join(codec.decode(ids, chunk=3)) == text


def test_bpe_long_pieces_and_few_states(tiktoken_codec):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(BYTES), public_tokenizers.PATTERN)
    codec.transducer.max_states = 50
    rnd = random.Random(4)
    for text in ("a" * 20_000, "".join(rnd.choice("abcdeinrst") for _ in range(20_000)), "-" * 9000):
        assert codec.encode(text) == tiktoken_codec.encode_ordinary(text)


def test_decoder_refuses_broken_characters(codec):
    decoder = byte_bpe.Decoder(codec.transducer.bytes_of)
    ranks = codec.transducer.ranks
    assert decoder.feed([ranks[b"\xe2"]]) == "" and decoder.feed([ranks[b"\x82"], ranks[b"\xac"]]) == "€"
    with pytest.raises(ValueError):
        decoder.feed([ranks[b"\xe2"], ranks[b"a"]])
    for code in [*range(0x80, 0x3000, 7), 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]:
        state = 0
        for byte in chr(code).encode():
            state = byte_bpe.utf8_step(state, byte)
        assert state == 0


def test_lookup_table_is_even_and_moves_little(spark):
    shards = [f"s{k}" for k in range(10)]
    size = sharding.prime_from(1000)
    table = sharding.lookup_table(shards, size)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    less = sharding.lookup_table(shards[:-1], size)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != 9)
    assert moved < 0.15 * size
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    changes = {(r["shard_before"], r["shard_after"]): r["n"] for r in sharding.moved(docs, shards, shards[:-1], size).collect()}
    assert sum(changes.values()) == 2000 and sum(n for (a, b), n in changes.items() if a == b) > 1500
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def sketch(text: str) -> set[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    hashes = {md5(g.encode()).hexdigest()[:16] for g in grams}
    low = {h for h in hashes if h < fingerprints.limit(fingerprints.SCALE)}
    return low or set(sorted(hashes)[:1])


def test_fingerprints_merge_and_estimate(spark, texts):
    rows = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts[:70])], "g long, t string")
    one = fingerprints.with_sketch(rows, "t", "sketch").select("g", "sketch")
    merged = {r["g"]: set(r["sketch"]) for r in fingerprints.merged(one, "g").collect()}
    for g in range(7):
        parts = [sketch(t) for t in texts[g:70:7]]
        low = {h for p in parts for h in p if h < fingerprints.limit(fingerprints.SCALE)}
        assert merged[g] == low
    part = " ".join(f"w{k}" for k in range(2000))
    whole = part + " " + " ".join(f"v{k}" for k in range(40_000))
    a, b = sketch(part), sketch(whole)
    assert len(a & b) / len(a) > 0.99 and len(a & b) / len(b) < 0.1


def brute_links(texts: list[str]) -> dict[int, set[int]]:
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    links = {k: set() for k in range(len(texts))}
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    return links


def test_near_copies_in_blocks(spark, monkeypatch):
    """A large group of near copies, some only linked through others, in blocks of a few nodes."""
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(150)]
    texts = []
    for _ in range(180):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(150)] = f"x{rnd.randint(0, 10_000)}"
        texts.append(" ".join(words))
    texts += texts[:20] + [" ".join(f"u{rnd.randint(0, 9999)}" for _ in range(100)) for _ in range(50)]
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    links = brute_links(texts)
    assert {k: r["n_links"] for k, r in found.items()} == {k: len(v) for k, v in links.items()}
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            for b in others:
                if root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {k: r["class_id"] for k, r in found.items()} == dict(enumerate(root))


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (300, 200), (100, 400), (7, 7)]
    rows = {r["node"]: r["root"] for r in jaccard_join.connected(spark.createDataFrame(edges, "node long, root long")).collect()}
    assert rows == {k: 0 for k in range(1, 61)} | {k: 100 for k in (200, 300, 400)}


def test_pruning_bound_keeps_similar_pairs():
    needed = jaccard_join.least_matches(0.8, 1e-6)
    assert needed == sorted(needed) and needed[0] < 13 and needed[-1] < 0.8 * 96
    rnd = np.random.default_rng(1)
    draws = rnd.random((20_000, 96)) < 0.8
    assert all((draws[:, : 16 * (k + 1)].sum(axis=1) >= n).mean() > 0.999 for k, n in enumerate(needed))


def test_plans_hold_every_piece_once():
    rnd = random.Random(6)
    for _ in range(200):
        cap = rnd.choice([10, 50, 128])
        counts = {rnd.randint(1, cap): rnd.randint(1, 60) for _ in range(rnd.randint(0, 20))}
        plan = packing.Plan(dict(counts), cap, groups=rnd.choice([2, 5, 20]))
        placed = Counter()
        for count, items in plan.classes:
            assert sum(n * times for n, times in items) <= cap
            for n, times in items:
                placed[n] += count * times
        assert +placed == Counter(counts)
        assert plan.sequences <= 2 * -(-sum(n * c for n, c in counts.items()) // cap) + 2


def test_packing_equals_the_library(spark, small, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    more = ["Ärger áb \x1c x　y 12ab'll \x85 <|startoftext|>x ΣΑΣ ẞ", "<|STARTOFTEXT|> IT'S E\u0301 İI", "IT'S E\u0301 \u0130I K\u212a", "a~b ~ ~~ c~ ~d x", ""]
    rows = list(enumerate(texts + more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs, path).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 4096))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 4096]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= 1.03 * sum(r["length"] for r in out) / 4096 + 1


def test_capitals_compose_before_they_are_lowered():
    """Marks that compose with the small letter only: the library composes first and lowers after."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pairs = ["J̌", "H̱", "T̈", "W̊", "Y̊"]
    texts = [*pairs, *(f"Ab{p}cD, {p.lower()} {p}. PLAIN {p}{p}" for p in pairs)]
    for text, ids in zip(texts, word_ids.WordIds(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_only_known_marks_compose_with_ascii_letters():
    letters = [chr(97 + k) for k in range(26)]
    marks = [c for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff" and (unicodedata.combining(c) or unicodedata.decomposition(c))]
    for c in marks:
        if not 0x300 <= ord(c) <= 0x37F:
            assert all(unicodedata.normalize("NFC", x + c)[0] == x for a in letters for x in (a, a.upper())), hex(ord(c))


def test_kth_largest(spark):
    rnd = random.Random(7)
    values = [rnd.randint(-(10**12), 10**12) for _ in range(500)] + [5] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 250, 549, 550):
        assert resampling.kth_largest(keys, k, bins=16) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(keys, 551) is None and resampling.kth_largest(keys, 0) is None


def test_importance_weights(spark, texts):
    rows = [(k % 5 == 0, t) for k, t in enumerate(texts)]
    ratios = resampling.log_ratios(spark.createDataFrame(rows, "good boolean, text string"))
    counts = np.ones((2, resampling.FAMILIES * resampling.BUCKETS))
    features = resampling.Features()
    for good, text in rows:
        for f in features(text)[0]:
            counts[0, f] += 1
            counts[1, f] += good
    shares = counts.reshape(2, resampling.FAMILIES, -1)
    shares = shares / shares.sum(axis=2, keepdims=True)
    assert np.allclose(ratios, np.log(shares[1] / shares[0]).ravel())


def test_classifier_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = resampling.resample(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_toxic_documents_that_read_well_go(spark):
    """Toxic documents of quality 1 whose words are those of good ones but for a few."""
    rnd = random.Random(9)
    docs, labels = [], []
    for k in range(600):
        words = [f"w{(k // 6 + j) % 40}" for j in range(80)]
        if toxic := k % 6 == 0:
            words[rnd.randrange(80)] = rnd.choice(["Vile,", "vile", "rotten!"])
        docs.append((k, " ".join(words)))
        if k % 3 == 0:
            labels.append((k, 1, int(toxic)))
    rows = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not any(kept[k] for k in range(0, 600, 6))
    assert sum(kept[k] for k in range(600) if k % 6) >= 0.97 * 500


def test_bundles_are_sums_of_bound_vectors():
    space = language.Space(64, 3)
    grams = language.trigrams("Ab1 ba?")
    assert [tuple(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams.tolist()] == [(" ", "a", "b"), ("a", "b", " "), ("b", " ", "b"), (" ", "b", "a"), ("b", "a", " ")]
    want = np.zeros(64)
    for g in grams.tolist():
        a, b, c = (space.letter(g >> s & 0x1FFFFF) for s in (42, 21, 0))
        want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(space.bundle(grams), want)
    assert not len(language.trigrams("12 ... ½"))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for order, kind in enumerate(personal.BASE):
        found += [(m.start(), order, m.end(), kind.name) for m in re.finditer(kind.pattern, text) if kind.test(m[0])]
    return [(a, b, n) for a, _, b, n in sorted(found)]


def test_base_spans_equal_plain_search(texts):
    rnd = random.Random(8)
    parts = [*"a@.-+% 1940()b\n", "ab", "@x.y", "4111 1111 1111 1111", "+49 30 1234567", "10.0.0.1", "256.1.1.1"]
    for text in texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(5000)]:
        got = [(a, b, k) for a, b, k, _ in personal.spans(text) if k in ("email", "ip", "card", "phone")]
        assert got == base_spans(text)


def test_check_digits_and_context():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.mod97("DE89370400440532013000") and not personal.mod97("DE89370400440532013001")
    kinds = lambda t: [k for _, _, k, _ in personal.spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 NOW") == ["iban"] and kinds("DE89 3704 0044 0532 0130 01") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert personal.masked("mail a@b.de or +49 (30) 1234567.") == "mail <email> or <phone>."


def test_frequent_lines_go(spark):
    body = lambda k: " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}x{j}" for j in range(60))
    rows = [(k, f"Menu 12 of SITE\n{body(k)}", "a") for k in range(40)] + [(99, "\n".join(["menu 7 of  site " * 4] + ["menu 3 of site"] * 30 + [" ".join(f"z{j}" for j in range(20))]), "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = line_rules.Limits(min_words=5, repeat_percent=1000)
    judged = {r["doc_id"]: r for r in line_rules.judge(docs, limits=limits).collect()}
    assert judged[0]["kept"] and judged[0]["removed_words"] == 4, judged[0]
    assert not judged[99]["kept"], judged[99]
    assert all(judged[k]["kept"] and judged[k]["removed_words"] == 4 for k in range(40)) and not judged[99]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in line_rules.clean(docs, limits=limits).collect()}
    assert cleaned == {k: body(k) for k in range(40)}
    # Copies of one text are one document, so they don't make their lines frequent.
    copies = docs.where("doc_id = 0").crossJoin(spark.range(100)).select("doc_id", "text", "source")
    assert line_rules.judge(copies, limits=limits).where("kept").count() == 100
