"""Collocations, fill-in-the-middle and token files against plain Python versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd import odd_documents

from tidewright.llm import byte_bpe, fill_in_middle, line_rules, lm_scores, personal, phrases, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ collocations
def plain_collocations(rows, min_count, min_percent, top):
    counts = {}
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        gone = {q for p, c in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * c >= min_percent * f[q]}
        rated = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(11)
    words = ["a", "b", "New", "YORK", "city", "é", "É", "x\xa0y", "\x1c", "of", "\x85", "the"]
    rows = [(k, "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None])) for k in range(120)]
    return [*rows, (900, None, "en"), (901, "", None), (902, " .. ,", "fr"), (903, "new york city " * 40, "es"), (903, "new york city " * 40, "es")]


@pytest.mark.parametrize("limits", [(phrases.MAX_PHRASES, phrases.MAX_WORDS, phrases.BURST), (40, 8, 3), (7, 1000, 1)])
@pytest.mark.parametrize("top", [2000, 9])
def test_collocations(spark, talk, limits, top):
    got = phrases.collocations(frame(spark, talk), min_count=4, top=top, limits=limits).collect()
    assert sorted(map(tuple, got)) == plain_collocations(talk, 4, 50, top)


def test_hot_first_word_is_many_partitions(spark):
    rows = [(k, f"the w{k % 40} x{k % 7}. the w{k % 40}", "en") for k in range(900)]
    got = phrases.collocations(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 10, 50, 2000)


def test_scores_pass_64_bits(spark):
    """A count of 10**9 squared and times 10**6 is above 2**63."""
    big = 10**9 + 7
    row = spark.createDataFrame([(big, big + 1, big + 5)], "a long, l long, r long")
    exact = "CAST(CAST(a AS DECIMAL(38, 0)) * a * 1000000 DIV (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT) AS score"
    assert row.selectExpr(exact).first()["score"] == 1_000_000 * big * big // ((big + 1) * (big + 5))


def test_trie_bursts_and_spills_whole_subtrees():
    rnd = np.random.default_rng(5)
    ids = rnd.zipf(1.3, (20_000, 3)) % 500
    keys = ids[:, 0] << 2 * phrases.ID_BITS | ids[:, 1] << phrases.ID_BITS | ids[:, 2]
    trie, total, deep = phrases.HatTrie(3, burst=200), Counter(), False
    for part in np.array_split(keys, 9):
        trie.add(part)
        deep = deep or any(isinstance(x, list) for x in trie.root)
        if trie.phrases > 3000:
            runs = list(trie.spill(1500))
            assert trie.phrases <= 1500 and len({k for own, _ in runs for k in trie.slots(own, 0)}) == len(runs)
            for own, counts in runs:
                total.update(dict(zip(own.tolist(), counts.tolist(), strict=True)))
    assert deep
    for own, counts in trie.spill(0):
        total.update(dict(zip(own.tolist(), counts.tolist(), strict=True)))
    assert trie.phrases == 0 and total == Counter(keys.tolist())


def test_collocations_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain_collocations(rows, 10, 50, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ fill-in-the-middle
def plain_middle(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return text, n, "plain", None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return out, n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m)


def test_middle(spark):
    rnd = random.Random(2)
    parts = ["ab", "Z", "é", " ", "\n", "<", "P", "S>", "<P", ">", "🙂", "\x00", "1", "<M>"]
    rows = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))) for k in range(2000)] + [(5, None), (None, "no id"), (5, "ab cd"), (5, "ab cd")]
    docs = frame(spark, rows, "doc_id long, text string")
    out = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restore(fill_in_middle.F.col("output"), fill_in_middle.F.col("form")))
    got = sorted((str(r["doc_id"]), r["output"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in out.collect())
    assert got == sorted((str(i), *plain_middle(i, t), t or "") for i, t in rows)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_middle_of_a_long_text_and_other_markers(spark):
    text = "word é " * 400_000
    docs = frame(spark, [(3, text)], "doc_id long, text string")
    row = fill_in_middle.transform(docs, markers=("[a]", "(b)", "{c}"), cut_percent=100, suffix_first_percent=100)
    back = row.select(fill_in_middle.restore(fill_in_middle.F.col("output"), fill_in_middle.F.col("form"), ("[a]", "(b)", "{c}")).alias("t"), "form", "n").first()
    assert back["t"] == text and back["form"] == "spm" and back["n"] == 1_600_000


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "xay", "z"), ("", "a", "b")])
def test_markers_that_could_be_mistaken_are_refused(spark, markers):
    with pytest.raises(ValueError):
        fill_in_middle.transform(frame(spark, [], "doc_id long, text string"), markers=markers)


# ------------------------------------------------------------------ token files
@pytest.mark.parametrize("high", [1, 2, 255, 256, 49_407, 2**32 - 1])
@pytest.mark.parametrize("n", [1, 7, 511, 512, 513, 5000])
def test_codes_give_every_id(high, n):
    rnd = np.random.default_rng(n)
    ids = (rnd.random(n) ** 6 * high).astype("<u4")
    ids[0] = high
    sink = pa.BufferOutputStream()
    token_files.write_file(sink, ids, pa.record_batch({"doc_id": pa.array([1]), "n_tokens": pa.array([n])}))
    file = token_files.TokenFile(sink.getvalue())
    assert len(file) == n and file.ids(0, n).tolist() == ids.tolist()
    assert [file[k] for k in range(0, n, max(1, n // 300))] == ids[:: max(1, n // 300)].tolist()
    for a, b in [(0, 0), (n, n), (n // 3, n // 2), (n - 1, n), (min(n, 512), n)]:
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file[n]


def test_widths_are_the_best():
    rnd = random.Random(9)

    def bits(widths, lengths):
        total, b = 0, 0
        for k, w in enumerate(widths):
            longer = sum(lengths[b + 1 :]) if b else sum(lengths)
            total += longer * (w + (k + 1 < len(widths)))
            b += w
        return total

    def cuts(n):
        return [[n]] + [[k, *rest] for k in range(1, n) for rest in cuts(n - k)]

    for _ in range(40):
        longest = rnd.randint(1, 9)
        lengths = np.array([0] + [rnd.choice([0, 1, 50, 900]) for _ in range(longest - 1)] + [rnd.randint(1, 80)] + [0] * (32 - longest))
        found = token_files.best_widths(lengths)
        assert sum(found) == longest and bits(found, lengths) == min(bits(w, lengths) for w in cuts(longest))


def test_broken_file_is_refused():
    with pytest.raises(ValueError):
        token_files.TokenFile(b"DAC1 and nothing else")


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("per_file", [token_files.TOKENS_PER_FILE, 2000])
def test_token_files(spark, small, tmp_path, per_file):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = plain_tokens(rows)
    folder = str(tmp_path / "t")
    token_files.write(docs.repartition(5), folder, WORDS, tokens_per_file=per_file)
    got = token_files.read(spark, folder, ids=True).collect()
    assert sorted(tuple(r) for r in got) == want
    listed = token_files.listing(folder)
    place, ids = 0, np.concatenate([w[4] for w in want])
    for f in listed:  # any place, without Spark
        file = token_files.TokenFile(pa.memory_map(f"{folder}/{f['name']}").read_buffer())
        assert all(file[k] == ids[place + k] for k in range(0, len(file), 97))
        place += len(file)
    assert place == len(ids) and (per_file > 2000 or len(listed) > 5)


def test_second_write_replaces_the_first(spark, tmp_path):
    folder = f"file://{tmp_path}/again"
    token_files.write(frame(spark, [(1, "one two")], "doc_id long, text string"), folder, WORDS)
    token_files.write(frame(spark, [(2, "three")], "doc_id long, text string"), folder, WORDS)
    assert [r["doc_id"] for r in token_files.read(spark, folder).collect()] == [2]


def test_token_files_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in token_files.round_trip(docs, WORDS).collect()]
    want = {(r[0], r[2], r[3]) for r in plain_tokens([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert len(rows) == docs.count() and {(i, n, c) for i, _, n, c in rows} == want
    ordered = sorted(rows, key=lambda r: r[1])
    assert [r[0] for r in ordered] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert all(b[1] == a[1] + a[2] for a, b in zip(ordered[:-1], ordered[1:], strict=True))
    assert token_files.round_trip(docs.limit(0), WORDS).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("key"), docs.text.alias("body"))
    assert token_files.round_trip(named, WORDS, "key", "body").where("key = '7'").count() == 1


# ------------------------------------------------------------------ byte-level codec on runs of texts
@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_digests(library, texts):
    out = []
    for t in texts:
        ids = library[1].encode_ordinary(t)
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_runs_of_texts_equal_the_library(library, small):
    import pyarrow.parquet as pq

    codec = byte_bpe.Codec(library[0], public_tokenizers.PATTERN)
    texts = [t or "" for t in pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()]
    assert codec.digests(pa.array(texts)) == plain_digests(library, texts)
    rnd = random.Random(6)
    parts = ["a", "b", " ", " ", "é", "the", "ing", " in", "\n", "  ", "1", "--", "=", "漢", "🙂", "'s", "　", "\x1c", "\x85", "́", "ſ", "\xa0", "\t", "<|endoftext|>", "'", "ll", ".", " \n", "\n "]
    for _ in range(60):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 80))]
        array = pa.array(["skipped", *texts]).slice(1)
        assert codec.digests(array) == plain_digests(library, texts)


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n", "\na b", "a b\n", "\n", " \n", "\n ", "a b \n", "x's 's", "a\x1c b", "a　 b", "é è", "🙂 🙂"])
def test_spaces_at_borders(library, text):
    codec = byte_bpe.Codec(library[0], public_tokenizers.PATTERN)
    assert codec.digests(pa.array([text, "plain text", text])) == plain_digests(library, [text, "plain text", text])


def test_other_pattern_and_forgotten_chunks(library, monkeypatch):
    import tiktoken

    pattern = r"[^ ]+ ?| +"  # pieces end with a space, so texts may not be cut before one
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library[0], special_tokens={})
    texts = ["one two  three", "four five"]
    assert [d[0] for d in byte_bpe.Codec(library[0], pattern).digests(pa.array(texts))] == [len(own.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 3)
    codec = byte_bpe.Codec(library[0], public_tokenizers.PATTERN)
    for _ in range(3):
        texts = [f"word{k} again word{k % 3}, and" for k in range(20)]
        assert codec.digests(pa.array(texts)) == plain_digests(library, texts)


def test_decoder_takes_any_cuts(library):
    decoder = byte_bpe.Decoder({i: b for b, i in library[0].items()})
    rnd = random.Random(12)
    for _ in range(200):
        text = "".join(rnd.choice("aé漢🙂 ſ\n") for _ in range(rnd.randint(0, 30)))
        ids, got, k = [library[0][bytes([x])] for x in text.encode()], "", 0
        while k < len(ids):
            n = rnd.randint(0, 4)
            got += decoder.feed(ids[k : k + n])
            k += n
        decoder.end()
        assert got == text
    with pytest.raises(ValueError):
        decoder.feed([library[0][b"\xe2"], library[0][b"a"]])


# ------------------------------------------------------------------ line rules on groups of near copies and numbers
def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdeghilmnorstu") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_one_of_many_near_copies_stays(spark):
    """200 near copies (nine of ten lines shared) beside 300 other documents of their host."""
    rnd = random.Random(4)
    shared = [prose(rnd, 9) for _ in range(10)]
    near = []
    for k in range(200):
        lines = list(shared)
        lines[k % 10] = prose(rnd, 9)
        near.append((k, "\n".join(lines), "h", 0))
    others = [(1000 + k, "\n".join(prose(rnd, 9) for _ in range(10)), "h", 0) for k in range(300)]
    docs = spark.createDataFrame(near + others, "doc_id long, text string, source string, n_chars long")
    judged = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    kept = [k for k in range(200) if judged[k]["kept"]]
    assert len(kept) == 1 and all(judged[1000 + k]["kept"] for k in range(300)) and not any(judged[k]["base_failed"] for k in range(200))
    cleaned = {r["doc_id"]: r["text"] for r in line_rules.clean(docs).collect()}
    assert set(cleaned) == {*kept, *range(1000, 1300)}
    left = "\n".join(cleaned[k] for k in kept).split("\n")
    assert all(left.count(line) <= 1 for line in shared) and cleaned[1007] == others[7][1]


def test_share_is_an_option(spark):
    rows = [(k, f"Read more on page {k}\nown {prose(random.Random(k), 60)}", "h", 0) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    removed = lambda **kw: line_rules.judge(docs, limits=line_rules.Limits(**kw)).where("removed_words > 0").count()
    assert removed() == 100 and removed(max_documents=100) == 0 and removed(share_percent=99) == 100 and removed(share_percent=100) == 0


def test_rows_of_numbers_stay_different(spark):
    rnd = random.Random(5)
    rows = [(k, "\n".join(" ".join(f"x{rnd.randint(1000, 9999)}" for _ in range(10)) for _ in range(8)), "h", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert line_rules.clean(docs).count() == 300


def plain_losses(texts, in_target, least):
    """Losses of the words of each text, from the definition."""
    words = [(t or "").encode().split() for t in texts]
    counts = []
    for target in (False, True):
        chosen = [w for w, own in zip(words, in_target, strict=True) if own or not target]
        counts.append((Counter(x for w in chosen for x in w), Counter(p for w in chosen for p in zip([None, *w], w)), sum(bool(w) for w in chosen)))
    known = {w for w, n in counts[0][0].items() if n >= least}
    kept = {p for p, n in counts[0][1].items() if n >= least}
    out = []
    for w in words:
        both = []
        for single, pairs, starts in counts:
            total = single.total()
            unknown = total - sum(single[x] for x in known)
            loss = 0.0
            for a, b in zip([None, *w], w):
                alone = ((single[b] if b in known else unknown) + 1) / (total + len(known) + 1)
                share = pairs[a, b] / max(starts if a is None else single[a], 1) if (a, b) in kept else 0
                loss -= math.log(lm_scores.MIX * share + (1 - lm_scores.MIX) * alone)
            both.append(loss / len(w) if w else None)
        out.append((len(w), both[1], both[0]))
    return out


@pytest.mark.parametrize(("least", "block_bytes"), [(2, 300), (3, 4000), (2, 1 << 22)])
def test_losses_follow_the_definition_in_any_blocks(spark, least, block_bytes):
    """Nulls, empty and repeated texts, rows without an id and repeated ids, in many blocks that are counted in small parts."""
    rnd = random.Random(6)
    some = prose(rnd, 90).split()
    text = lambda n: " ".join(rnd.choice(some) if rnd.random() < 0.9 else prose(rnd, 1) for _ in range(n))
    texts = [text(40) for _ in range(120)]
    texts += [texts[0]] * 30 + [None, "", " \n", "once", text(3000)]
    ids = [None if k % 9 == 0 else k % 110 for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id int, text string").repartition(7)
    target = spark.createDataFrame([(k,) for k in range(0, 200, 3)] + [(None,), (3,)], "doc_id long")
    in_target = [k is not None and k % 3 == 0 for k in ids]
    want = plain_losses(texts, in_target, least)
    got = lm_scores.score(docs, target, least=least, block_bytes=block_bytes, max_tokens=150).collect()
    key = lambda r: tuple("" if x is None else f"{x:.8f}" for x in r)
    assert sorted(key(r[:4]) for r in got) == sorted(key((k, *w)) for k, w in zip(ids, want, strict=True))


def test_long_runs_of_digits_and_dots_take_linear_time():
    started = time.monotonic()
    million = "7" * 1_000_000
    assert [x[:3] for x in personal.spans(f"{million}. 10.0.0.1") if x[2] == "ip"] == [(1_000_002, 1_000_010, "ip")]
    assert sum(x[2] == "ip" for x in personal.spans("1." * 400_000)) == 100_000
    assert not [x for x in personal.spans(f"{million}.{million}.1.2") if x[2] == "ip"]
    assert time.monotonic() - started < 20


def test_addresses_equal_plain_search():
    rnd = random.Random(7)
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rnd.choice("0125.. a") for _ in range(rnd.randint(1, 40)))
        want = [m.span() for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [x[:2] for x in personal.spans(text) if x[2] == "ip"] == want
