"""The training-data operators against brute force, libraries, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import chat, common, exact_dedup, html_text, minhash, mixing, near_balls, pieces, quality, secrets, simhash, token_files, toxicity
from loamline.llm.queries import ORACLES, QUERIES, tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASH = ["name", "h", "block", "fp", "size", "kept", "target", "ids", "spans", "_row", "_text", "toxic", "quality"]


def word(r):
    return "".join(r.choice(["an", "ou", "the", "re", "é", "st"]) for _ in range(r.randrange(1, 4)))


def corpus(n=160, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(word(r) for _ in range(r.choice([0, 3, 25, 60, 400])))
        if i % 5 == 4:
            text = rows[r.randrange(len(rows))][1]
        elif i % 7 == 6 and rows[-1][1]:
            text = rows[-1][1] + " " + word(r)
        rows.append((i, text, "en", r.choice(["a", "b", "b", "b", None]), len(text or "")))
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, "no id " * 10, "en", "b", 60), (902, "x y " * 20_000, "en", "b", 80_000), (3, rows[3][1], "en", "a", 0), (3, rows[3][1], "en", "a", 0), (4, "other text with a known id", "en", "a", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A stored table with nulls, empty and long texts, repeated rows and clashing columns."""
    at = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(corpus(), SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    df.repartition(3).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(at)
    return spark.read.parquet(at)


def low(x):
    return -1 if x is None else x


# ---- exact dedup


@pytest.mark.parametrize("options", [{}, {"block_chars": 8}, {"block_chars": 5, "hot_least": 2}])
def test_exact_dedup(docs, options):
    got = exact_dedup.exact_dedup(docs, **options).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    want = Counter((i, max(g, key=low), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_stage(docs, empty):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len({t or "" for _, t, *_ in corpus()})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


# ---- token files


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


def test_word_encoder_equals_library(bpe):
    r = random.Random(3)
    signs = ["ab", "c", "E", "é", "ñ", "×", "÷", "'", "'s", "'ll", '"', " ", " ", "  ", "\n", "\n\n", ".", "5", "½", "日", "\t", " ", "<|endoftext|>", "¿", "_"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(4000)] + ["it's 'tis rock'n'roll's dogs' 'q", "x" * 100 + " " + "é" * 40, ""]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "plain"]
    coder = token_files.WordEncoder(tokenizer_file("byte_bpe_50k.json"), 1 << 9)  # small: it is emptied often
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at : at + 100], coder.encode(texts[at : at + 100])):
            assert ids.tolist() == bpe.encode(t, add_special_tokens=False).ids, repr(t)
    assert 50256 in coder.encode(["a <|endoftext|> b"])[0]
    coder = token_files.WordEncoder(tokenizer_file("byte_bpe_50k.json"), 1 << 9, special_as_text=True)
    assert 50256 not in coder.encode(["a <|endoftext|> b"])[0]


def test_other_tokenizers_see_whole_texts():
    """A file with another pre-tokenizer: the cuts made for byte-level files would give wrong ids."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), token_files.WordEncoder(path, 1 << 9)
    for t in ("It's   A test\nof two lines!!", "", "Ünïcode 日本 don't 12345"):
        assert coder.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(docs, empty, bpe, monkeypatch):
    got = token_files.read_token_files(token_files.write_token_files(docs, tokenizer_file("byte_bpe_50k.json"))).collect()
    start, want = 0, []
    for i, t, *_ in sorted(corpus(), key=lambda r: (low(r[0]), r[1] or "")):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.read_token_files(token_files.write_token_files(empty, tokenizer_file("byte_bpe_50k.json"))).count() == 0


def test_shard_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 7)
    r = random.Random(1)
    rows = [(k, np.array([r.randrange(1 << 32) for _ in range(r.choice([0, 1, 7, 20]))], "<u4").tobytes()) for k in range(30)]
    w = token_files.ShardWriter(f"file://{tmp_path}/s.ltok")
    for k, b in rows:
        w.add(k, b)
    w.close()
    assert [(i, b"".join(p), n) for i, p, n in token_files.read_shard(f"file://{tmp_path}/s.ltok")] == [(k, b, len(b) // 4) for k, b in rows]


# ---- SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps):
    """The smallest index reachable over links of three bits or fewer, for each fingerprint."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(docs, empty, monkeypatch):
    rows = corpus()
    got = simhash.near_groups(docs)
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    label = classes(fps)
    least = defaultdict(lambda: None)
    for (i, *_), c in zip(rows, label):
        if i is not None:
            least[c] = i if least[c] is None else min(least[c], i)
    want = Counter((i, f, least[c]) for (i, *_), f, c in zip(rows, fps, label))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got.collect()) == want
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_links_of_flipped_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 6))}))
    fps |= {0, (1 << 64) - 1, 7, 1 << 63}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    comp = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    order = sorted(fps)
    label = classes(order)
    mine = [comp.get(f, f) for f in order]
    assert len({(a, b) for a, b in zip(label, mine)}) == len(set(label)) == len(set(mine))


def test_dense_groups_equal_brute_force():
    r = random.Random(4)
    outer = r.getrandbits(64) & ~(0xFFFF << 16)
    fps = sorted({outer ^ (r.choice([0, 1, 1 << 40, 1 << 63])) | r.randrange(1 << 16) << 16 for _ in range(400)})
    label = classes(fps)
    for pairs in (list(simhash._near_dense(np.array(fps, np.uint64), 1)), list(simhash._near(np.array(fps, np.uint64)))):
        up = {f: f for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            for x, y in zip(a.tolist(), b.tolist()):
                up[root(y)] = root(x)
        got = [root(f) for f in fps]
        assert len(set(zip(label, got))) == len(set(label)) == len(set(got))


def test_long_texts_are_cut_at_words(monkeypatch):
    text = "One two  three\nfour " * 50
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 13)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


# ---- chat


def test_chats_round_trip(spark):
    r = random.Random(6)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\l", "\\b", "\\e", "<", "[", "😀", "a\nb", ""]
    rows = [(c, n, r.choice(["user", "assistant", "assistant", "we[INST]ird", None]), r.choice(["".join(r.choice(bits) for _ in range(5)), None, ""])) for c in range(40) for n in range(r.randrange(1, 9))]
    rows += [(50, None, "user", "first"), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("said", F.lit(1)).withColumn("loss", F.lit(1))
    made = chat.format_chats(turns)
    got = {b["conv_id"]: b for b in chat.read_chats(made).collect()}
    want = defaultdict(list)
    for c, n, role, text in sorted(rows, key=lambda x: (low(x[0]), x[1] is not None, low(x[1]), x[2] or "", x[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in b["turns"]] for c, b in got.items()} == dict(want)
    assert all(b["loss_texts"] == [t for role, t in want[c] if role == "assistant"] for c, b in got.items())
    for f in made.collect():
        plain = re.sub(r"<s>|</s>|\[/?INST\]", "", f["formatted"])
        assert not re.search(r"<s>|</s>|\[/?INST\]", plain)
    merged = made.filter("conv_id = 50").first()["formatted"]
    assert merged == "<s>user[INST]first[/INST]</s><s>assistant[INST]tie[/INST][INST]tie[/INST]</s>"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_conversations(spark):
    import time

    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é[INST]"), F.col("id")).alias("text"))
    turns = turns.unionByName(spark.createDataFrame([(2, 0, "assistant", "x" * 3_000_000), (2, 1, "user", None)], "conv_id int, turn bigint, role string, text string"))
    began = time.time()
    got = {b["conv_id"]: b for b in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [f"é[INST]{k}" for k in range(n)]
    assert got[1]["loss_texts"] == [f"é[INST]{k}" for k in range(n) if k % 3] and got[2]["loss_texts"] == ["x" * 3_000_000]
    assert time.time() - began < 120


# ---- quality


def brute_statistics(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    lines = [line for line in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, docs):
    r = random.Random(8)
    texts = ["\n".join(" ".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(r.randrange(8))) for _ in range(200)]
    texts += [None, "", " \t", "a b c d e f g h a b c d e f g h", "w " * 500, "# $ | <x>\n\n \n#", " x\x1cy é😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in quality.text_statistics(df, keep=["doc_id"]).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(texts)}


def test_decision_list_learns_planted_rules():
    r = random.Random(9)
    rows = []
    for i in range(1500):
        f = {"symbols": r.random(), "words": r.random() * 100, "noise": r.random()}
        rows.append((i, not (f["symbols"] >= 0.8 or (f["words"] < 30 and f["noise"] >= 0.9)), f))
    rules = quality.learn_decision_list(rows[:1000])
    right = sum(rules.keeps(f) == good for _, good, f in rows[1000:])
    assert right >= 490 and 1 <= len(rules.rules) <= 6
    assert quality.learn_decision_list([]).rules == () and quality.learn_decision_list([(1, True, {"a": 1.0})] * 9).rules == ()


def test_condition_equals_rules(spark, docs, empty):
    rules = quality.DecisionList((quality.Rule((("symbols", True, 0.2), ("words", False, 50.0))), quality.Rule((("stutter", True, 0.3),))))
    got = quality.judge_quality(docs.select("doc_id", "text"), rules, keep=["doc_id"])
    names = list(quality.features())
    for r in got.select("*", *[c.alias(f"f_{n}") for n, c in quality.features().items()]).collect():
        base = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == base and r["kept"] == (not base and rules.keeps({n: r[f"f_{n}"] for n in names}))
    clash = docs.select("doc_id", "text").withColumns({"n_words": F.lit(1), "kept": F.lit(1)})
    assert quality.judge_quality(clash, rules).count() == docs.count() and quality.judge_quality(clash, rules).columns.count("n_words") == 1
    assert quality.drop_poor(docs, rules).columns == docs.columns and quality.drop_poor(empty, rules).count() == 0


def test_quality_is_learned_from_labels(spark):
    r = random.Random(11)
    rows = [(i, " ".join(word(r) + ("###" if i % 4 == 0 else "") for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    judged = quality.judge_quality(df, quality.fit_quality(df, labels), keep=["doc_id"]).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in judged)
    assert quality.fit_quality(df, labels.limit(0)).rules == ()


# ---- secrets


def test_secrets(spark):
    r = random.Random(12)
    bits = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "abcdef1", "AKIA", "ABCD1234EFGH5678", "0123abcd" * 3, "é", "\n", "wJalrXUtnFEMI7K7MDENG0bPxRf8CYq2"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(600)] + [None, "", "token=token: abcdefg", "x" * 5000]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep=["doc_id"]).collect()
    seen = 0
    for row in got:
        t = texts[row["doc_id"]] or ""
        want = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
        want += [(m.start(), 1, "access", m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20]
        want += [(m.start(), 2, "hex", m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24]
        assert [tuple(s) for s in row["spans"] if s["kind"] != "entropy"] == sorted(want), repr(t)
        seen += sum(s["kind"] == "entropy" for s in row["spans"])
    assert seen > 0


def test_entropy_windows(spark):
    r = random.Random(13)
    cs = ["".join(r.choice("abcdef0123456789XYZ+/") for _ in range(n)) for n in (24, 25, 40, 120)] + ["a1" * 20, "a" * 23 + "1"]
    brute = lambda c: min(sum(secrets.PARTS[c[k : k + 24].count(x)] for x in set(c[k : k + 24])) for k in range(len(c) - 23))
    got = spark.createDataFrame([(c,) for c in cs], "c string").select(secrets.least_parts(F.col("c"))).collect()
    assert [g[0] for g in got] == [brute(c) for c in cs]
    quiet = ["550e8400-e29b-41d4-a716-446655440000", "some-long-name-with-many-words-2024", "EXAMPLEwJalrXUtnFEMI7K7MDENGbPxRfi"]
    df = spark.createDataFrame([(k, f"see {q} here") for k, q in enumerate(quiet)], "doc_id bigint, text string")
    assert all(not r["spans"] for r in secrets.find_secrets(df).collect())
    # a placeholder takes away only its own part
    key = "".join(r.choice("abcdefghijkXYZ0123456789") for _ in range(40))
    df = spark.createDataFrame([(0, f"sample_key={key} /sample/{key}")], "doc_id bigint, text string")
    assert [s["kind"] for s in secrets.find_secrets(df).first()["spans"]] == ["entropy"] * 2


def test_secrets_of_overlapping_kinds(spark):
    r = random.Random(19)
    key = lambda n: "".join(r.choice("abcdefghijkXYZ0123456789+/") for _ in range(n))
    bits = [lambda: f"token={key(30)}", lambda: key(30), lambda: "AKIA" + "QWERTYUIOPASDFGH", lambda: "0123456789abcdef" * 2, lambda: "é", lambda: "x" + "0a1b2c3d4e5f" * 3 + key(9)]
    texts = [r.choice([" ", "", "\n"]).join(r.choice(bits)() for _ in range(r.randrange(1, 12))) for _ in range(150)]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), keep=["doc_id"]).collect()
    seen = Counter()
    for row in got:
        spans = [tuple(s) for s in row["spans"]]
        assert spans == sorted(spans)
        base = [s for s in spans if s[1] < 3]
        t = texts[row["doc_id"]]
        for m in re.finditer(secrets.CANDIDATE, t):
            w = m[0]
            least = min(sum(secrets.PARTS[w[k : k + 24].count(x)] for x in set(w[k : k + 24])) for k in range(len(w) - 23))
            parts = re.split(secrets.SEPARATORS, w)
            quiet = re.search(secrets.UUID, w) or (len(parts) > 1 and all(re.search(secrets.PLAIN_PART, p) for p in parts))
            quiet = quiet or (any(re.search(secrets.PLACEHOLDER, p) for p in parts) and sum(len(p) for p in parts if not re.search(secrets.PLACEHOLDER, p)) < 24)
            limit = next(secrets._limit(bits) for _, p, bits in secrets.CLASSES if re.search(p, w))
            want = not quiet and least <= limit and not any(b[0] < m.end() and m.start() < b[3] for b in base)
            assert ((m.start(), 3, "entropy", m.end()) in spans) == want, w
            seen[want] += 1
    assert min(seen.values()) > 20


def test_secrets_in_long_texts_tables_and_clashes(spark):
    import time

    r = random.Random(21)
    run = "".join(r.choice(secrets.SIGNS[:64]) for _ in range(1_000_000))
    keys = " ".join(f"token=abc{k:07}" for k in range(50_000))
    df = spark.createDataFrame([(1, run), (2, keys), (2, keys)], "doc_id bigint, text string")
    began = time.time()
    got = secrets.find_secrets(df, keep=["doc_id"]).select("doc_id", F.size("spans").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 50_000), (2, 50_000)]
    assert time.time() - began < 120
    clash = spark.createDataFrame([(1, "token=abcdefg", 5, 6)], "doc_id bigint, text string, spans int, kind int")
    assert secrets.find_secrets(clash).columns == ["doc_id", "text", "kind", "spans"] and len(secrets.find_secrets(clash).first()["spans"]) == 1
    assert secrets.find_secrets(df.limit(0)).count() == 0


# ---- pieces


def test_pieces_equal_library():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path, remembered=50)
    r = random.Random(14)
    signs = ["a", "b", "e", "r", "s", "t", "the", "tion", " ", "  ", "\n", "é", "日本", "😀", ".", "...", "1", "\0", "▁", "ț"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(50))) for _ in range(3000)] + ["", "a" * 3000, "The IllegalArgumentException addEventListener()" * 5]
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        for t, ids, want in zip(part, coder.encode(part), library.encode(part)):
            assert ids.tolist() == want, repr(t)
            assert coder.decode(ids) == t.replace("▁", " ")


def test_pieces_of_documents(docs, empty):
    path = tokenizer_file("piece_bpe_32k.model")
    got = pieces.encode_and_check(docs, path).collect()
    assert len(got) == len(corpus()) and all(r["same"] for r in got)
    assert pieces.encode_pieces(empty, path).count() == 0
    assert {len(r["ids"]) for r in pieces.encode_pieces(docs.filter("text is null or text = ''"), path).collect()} == {0}


# ---- toxicity


def test_chain_on_held_out_labels(spark):
    r = random.Random(15)
    rows, labels = [], []
    for i in range(900):
        w = [word(r) for _ in range(40)]
        poor, toxic = i % 3 == 0, i % 5 == 0
        if poor:
            w[3] = "junkjunk"
        if toxic:
            w[7] = r.choice(["vilest", "awfulness", "awfulish", "awfuls"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic", F.lit(9))
    known = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    cats = {"poor": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.fit_chain(df, known, cats)
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score_toxicity(df.select("doc_id", "text"), chain).collect()}
    assert sum(got[i] == bool(t) for i, _, t in labels if i >= 600) >= 297 and not got[1000] and not got[1001]
    assert [len(w) for w in chain.weights] == [len(chain.selected) + 1, len(chain.selected) + 2]
    # no rows, repeated rows, a long text, clashing names, and a probability that equals the threshold
    text = df.select("doc_id", "text")
    assert toxicity.score_toxicity(text.limit(0), chain).count() == 0
    many = spark.createDataFrame([(1, "x " * 400_000 + "vilest awfulness"), (2, rows[0][1]), (2, rows[0][1])], "doc_id bigint, text string")
    p = toxicity.score_toxicity(many.withColumn("p_toxic", F.lit(1)), chain).collect()
    assert len(p) == 3 and p[0]["toxic"] and len({x["p_toxic"] for x in p if x["doc_id"] == 2}) == 1
    tie = toxicity.Chain(chain.categories, chain.selected, chain.weights, (0.5, p[0]["p_toxic"]))
    assert toxicity.score_toxicity(many.limit(1), tie).first()["toxic"]
    none = toxicity.fit_chain(df, known.limit(0), cats)
    assert not any(x["toxic"] for x in toxicity.score_toxicity(df.select("doc_id", "text"), none).collect())


# ---- mixing


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"], r["source"] or "")
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(corpus())
    total, by = sum(r["size"] for r in got), defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] or r["size"] == 0
    # the water level by repeated sharing
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), mixing.WEIGHTS))
    size = {s: sum(r["size"] for r in rows) for s, rows in by.items()}
    target, open_ = {}, set(by)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        for s in full or open_:
            target[s] = 3 * size[s] if full else share[s]
        open_ = open_ - full if full else set()
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in got)


def test_mix_comes_near_targets(spark):
    r = random.Random(16)
    df = spark.createDataFrame([(i, "w " * int(r.paretovariate(1.2) * 20), f"s{i % 4}") for i in range(2000)], "doc_id bigint, text string, source string")
    by = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 1.5 * x["largest"] for x in by)


# ---- near copies of the pipeline


def alike_groups(texts):
    """The smallest index reachable over pairs of a similarity of 0.8 or more, by comparing all pairs."""
    own = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        own.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    alike = [(i, j) for i in range(len(own)) for j in range(i) if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
    label = list(range(len(own)))
    for _ in label:
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_stage_finds_similar_texts(spark):
    """Against all pairs: texts with changed words at similarities around 0.8, in clusters and chains."""
    r = random.Random(23)
    texts = []
    for _ in range(12):
        base = [f"{word(r)}{r.randrange(1000)}" for _ in range(r.choice([30, 80, 300]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(r.randrange(1 + len(copy) // 40)):
                copy[r.randrange(len(copy))] = word(r)
            texts.append(" ".join(copy))
            base = copy if r.random() < 0.5 else base
    texts += ["", None, " ", "a b c", "A b  c", "a b d"]
    label = alike_groups(texts)
    got = corpus_pipeline.near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "").collect()
    assert sorted(x["doc_id"] for x in got) == sorted(set(label))
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_near_stage_compares_all_of_a_bucket(spark, monkeypatch):
    """One bucket for everything: pairs that no end of the bucket is part of are still found."""
    monkeypatch.setattr(minhash, "bands", lambda own: np.zeros(minhash.BANDS, np.uint64))
    r = random.Random(29)
    base = [" ".join(word(r) + str(k) for k in range(60)) for _ in range(6)]
    texts = base + [t + " end" for t in base]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(x["doc_id"] for x in minhash.drop_similar(docs).collect()) == list(range(6))


def test_near_stage_takes_candidates_from_simhash_balls(spark, monkeypatch):
    """Without any MinHash bucket: pairs at the limit, also of four shingles in five, are found, those below it are not."""
    monkeypatch.setattr(minhash, "bands", lambda own: own.sum() + np.arange(minhash.BANDS, dtype=np.uint64))
    r = random.Random(31)
    texts = []
    for n in [9] * 60 + [40, 100, 500] * 15:
        base = [f"{word(r)}{r.randrange(10**6)}" for _ in range(n)]
        cut = (n - 4) // 5 + r.randrange(2)
        texts += [" ".join(base), " ".join(base[cut:])]
    label = alike_groups(texts)
    assert 60 < len(set(label)) < len(texts)
    got = corpus_pipeline.near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "").collect()
    assert sorted(x["doc_id"] for x in got) == sorted(set(label))


def test_balls_meet_as_all_pairs_say():
    """Parts together against all pairs of sets; a point with more than DENSE sets keeps them all."""
    r = np.random.default_rng(37)
    bits, m, first = 24, 3, 2
    noise = lambda rate, n: np.packbits(r.random((n, m, 64)) < rate, axis=2, bitorder="little").view("<u8")[:, :, 0]
    fps = (r.integers(0, 1 << 64, (40, 1, m), np.uint64) ^ noise(0.08, 200).reshape(40, 5, m)).reshape(-1, m)
    fps[:80] = fps[0]
    ids = r.integers(0, 1 << 64, len(fps), np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, fps.size + 1, m, dtype=np.int32)), pa.array(fps.view(np.int64).ravel()))
    sent = near_balls._sent(bits, m, first)(iter([pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), lists], names=["set", "marks"])]))
    got = set()
    for b in sent:
        for part, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by = defaultdict(list)
            for bucket, own in zip(*near_balls.meeting(np.frombuffer(rows, np.uint64).reshape(-1, 3), part, bits, first)):
                by[bucket].append(int(own))
            assert all(len(v) == len(set(v)) > 1 for v in by.values())
            got |= {frozenset((x, y)) for v in by.values() for x in v for y in v if x != y}
    want = set()
    for key in range(2 * m):
        j = key // 2
        x, y, half = fps[:, j], fps[:, (j + 1) % m], fps[:, j] >> np.uint64(32 * (key % 2)) & np.uint64((1 << bits) - 1)
        for i in range(len(fps)):
            near = (np.bitwise_count(half ^ half[i]) <= 2) & (np.bitwise_count(x ^ x[i]).astype(int) + np.bitwise_count(y ^ y[i]) <= near_balls.CLOSE)
            want |= {frozenset((int(ids[i]), int(ids[k]))) for k in np.flatnonzero(near) if k != i}
    assert len(want) > 3000 and want <= got


def test_fingerprints_of_many_sets():
    r = np.random.default_rng(41)
    sets = [np.unique(r.integers(0, 1 << 64, n, np.uint64)) for n in (1, 2, 254, 255, 256, 511, 700)]
    for own, row in zip(sets, near_balls.fingerprints(sets, 3)):
        alone = near_balls.fingerprints([own], 3)[0]
        assert row.tolist() == alone.tolist() and len(set(row.tolist())) == 3
    near, far = [], []
    for _ in range(200):
        z = r.integers(0, 1 << 64, 100, np.uint64)
        f = near_balls.fingerprints([z[:90], z[10:], r.integers(0, 1 << 64, 90, np.uint64)], 4)
        near.append(np.bitwise_count(f[0] ^ f[1]).mean() / 64)
        far.append(np.bitwise_count(f[0] ^ f[2]).mean() / 64)
    # two sets with cosine 8/9, and unlike ones
    assert abs(np.mean(near) - math.acos(8 / 9) / math.pi) < 0.01 and abs(np.mean(far) - 0.5) < 0.01


# ---- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; bold</h1><p><b>First   part<br>goes
on<p>Second &eacute;&#x41; <i>in</i>line</p><div class="ad">Buy</div><form><input>Sign up</form><ul><li>one<li>two</ul>
<section class="comments"><p>Nice!</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Big & bold\nFirst part goes on\nSecond éA inline\none\ntwo"
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<p>a < b") == "a < b"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text("<main><p>x</p><!-- y --></main><p>z") == "x"


def test_wrappers(spark):
    r = random.Random(17)
    page = lambda k: f"<html><body><div class=top>Daily Paper of Record</div><div class=x><p>{' '.join(word(r) for _ in range(50))} {k}</p><p>All rights kept by us</p></div></body></html>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(12)] + [(20, "http://one.org/", page(20)), (21, None, None), (22, "bad", ""), (5, "http://h.org/5", page(5))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("x"))
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows) and all(x["n_chars"] == len(x["text"]) for x in got)
    own = [x for x in got if x["url"] and "h.org" in x["url"]]
    assert all("Daily" not in x["text"] and "rights" not in x["text"] and len(x["text"].split()) == 51 for x in own)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_tree_match_counts_common_nodes():
    a, b = html_text.parse("<div><p>x</p><p>y</p><ul><li>1</ul></div>"), html_text.parse("<div><p>x</p><ul><li>1<li>2</ul></div>")
    # the page, div, p and its text, ul, li and its text
    assert html_text.tree_match(a, b) == 7


def random_tree(r, depth=0):
    """(sign, children) with texts as leaves; neighbours differ, so that texts don't run together."""
    kids = []
    for _ in range(r.randrange(0, 5 if depth < 3 else 1)):
        kids.append(random_tree(r, depth + 1) if r.random() < 0.7 or (kids and kids[-1][0] == "#") else ("#", word(r) * r.randrange(1, 3)))
    return (r.choice(["div", "ul", "section", "div.x"]), kids)


def markup(t):
    if t[0] == "#":
        return t[1]
    tag, _, mark = t[0].partition(".")
    return f"<{tag}{f' class={mark}' if mark else ''}>{''.join(map(markup, t[1]))}</{tag}>"


def brute_match(a, b):
    if a[0] != b[0]:
        return 0
    x, y = ([] if n[0] == "#" else n[1] for n in (a, b))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            w = brute_match(p, q)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    return best[-1][-1] + 1


def test_tree_match_equals_brute_force():
    r = random.Random(47)
    for _ in range(300):
        a, b = random_tree(r), random_tree(r)
        if r.random() < 0.5:  # a changed copy
            b = (a[0], [k for k in a[1] if r.random() < 0.8 or k[0] != "div"])
            b = (b[0], [k for i, k in enumerate(b[1]) if k[0] != "#" or not i or b[1][i - 1][0] != "#"])
        one, two = (html_text.Outline(html_text.parse(markup(t))) for t in (a, b))
        align = html_text.Alignment(one, two)
        n = align.weigh()
        assert n == 1 + brute_match(a, b), (markup(a), markup(b))
        pairs = list(align.pairs())
        assert len(pairs) == n and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == n
        up = lambda o: {k: i for i, own in enumerate(o.kids) for k in own}
        over, under = up(one), up(two)
        assert all(one.sign[i] == two.sign[j] for i, j in pairs) and {(over[i], under[j]) for i, j in pairs if i} <= set(pairs)


def test_long_flat_pages_are_matched_quickly():
    import time

    page = lambda k: "<div class=x>" + "".join(f"<p>{i}</p>" if (i * k) % 7 else f"<ul><li>{i}</ul>" for i in range(3000)) + "</div>"
    began = time.time()
    assert html_text.tree_match(html_text.parse(page(3)), html_text.parse(page(5))) > 5000
    assert time.time() - began < 10


def test_wrapper_equals_brute_force(spark):
    """Pages of a menu, content and a footer without telling marks: places and counts by an independent alignment."""
    r = random.Random(53)
    pages = []
    for k in range(14):
        menu = ("ul", [("li", [("#", f"entry {i}")]) for i in range(6) if r.random() < 0.9])
        body = ("div.post", [("p", [("#", words_of(r, 12))]) for _ in range(r.randrange(1, 7))])
        foot = ("div.low", [("p", [("#", "kept by us")]), ("p", [("#", r.choice(["one", "two", "three"]))])])
        pages.append(("div.page", [menu, *([("div.date", [("#", words_of(r, 2))])] if r.random() < 0.5 else []), body, foot]))

    def count(a):
        return 1 if a[0] == "#" else sum(map(count, a[1]))

    def leaves(a, b, at=()):
        """(place in a, text in a, text in b) of the leaves of a largest common tree, with equal subtrees in pairs if may be."""
        if a[0] == "#":
            return [(at, a[1], b[1])]
        x, y = a[1], b[1]
        best = [[((0, 0), [])] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                n, (score, own) = brute_match(x[i], y[j]), best[i][j]
                here = ((score[0] + n, score[1] + (count(x[i]) if x[i] == y[j] else 0)), [*own, (i, j)]) if n else ((0, 0), [])
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], here, key=lambda z: z[0])
        return [t for i, j in best[-1][-1][1] for t in leaves(x[i], y[j], (*at, i))]

    def texts(a):
        return [a[1]] if a[0] == "#" else [t for k in a[1] for t in texts(k)]

    got = read_pages(spark, [markup(p) for p in pages])
    same = Counter()
    for ref in pages:
        for p in pages:
            same.update((i, t) for i, t in {(pages.index(ref), t) for _, t, u in leaves(ref, p) if t == u})
    # every text that any reference could find: menu entries and the line of the footer, but no content
    everywhere = {t for (_, t), n in same.items() if 2 * n > len(pages)}
    assert everywhere and all(set(got[k].split("\n")) == set(texts(p)) - everywhere for k, p in enumerate(pages))


def words_of(r, n):
    return " ".join(word(r) + str(r.randrange(10_000)) for _ in range(n))


def read_pages(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.org/{k}", p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {x["page_id"]: x["text"] for x in html_text.extract_pages(df).collect()}


def test_every_varying_place_is_read(spark):
    r = random.Random(31)
    parts = [[words_of(r, n) for n in (4, 12, 60, 40, 20)] for _ in range(8)]
    page = lambda t: f"<div class=top>Paper of Record</div><div class=post><h1>{t[0]}</h1><p>{t[1]}</p>" + "".join(f"<div class=sec><p>{x}</p></div>" for x in t[2:]) + "</div>"
    got = read_pages(spark, [page(t) for t in parts])
    assert all(got[k] == "\n".join(t) for k, t in enumerate(parts))


def test_template_of_any_length(spark):
    r = random.Random(37)
    menu = "<ul>" + "".join(f"<li>entry {k:03}" for k in range(450)) + "</ul>"
    texts = [words_of(r, 600) for _ in range(6)]
    got = read_pages(spark, [f"<div class=x>{menu}<p>{t}</p></div>" for t in texts])
    assert got == dict(enumerate(texts))


def test_template_from_all_pages(spark):
    """Many copies, pages of any length, and a text that only a few pages share."""
    r = random.Random(41)
    page = lambda t, extra="": f"<div class=x><p>All rights kept by us</p><p>{t}</p>{extra}</div>"
    texts = [words_of(r, 60) for _ in range(12)]
    shared = "<p>a correction that three pages carry</p>"
    pages = [page(texts[0])] * 60 + [page(t, shared if k < 3 else "") for k, t in enumerate(texts[1:])]
    got = read_pages(spark, pages)
    assert [got[k] for k in range(59, 71)] == [t + ("\na correction that three pages carry" if 0 < k < 4 else "") for k, t in enumerate(texts)]
    texts = [words_of(r, 7_000) for _ in range(5)]
    assert all(len(t) > 40_000 for t in texts)
    assert read_pages(spark, [page(t) for t in texts]) == dict(enumerate(texts))


def test_named_wrappers_around_the_text():
    story = "<h1>Head</h1><p>" + "one two three " * 5 + "</p>"
    want = "Head\n" + " ".join("one two three".split() * 5)
    for a, z in (("<div class='content-area with-sidebar'>", "</div>"), ("<div id=page class='site no-sidebar'>", "</div>"), ("<div class='post has-comments'>", "</div>"), ("<form action=x>", "</form>")):
        for b, y in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")):
            assert html_text.main_text(f"{a}{b}{story}{y}<div class=comments><p>Nice</p></div>{z}<footer>f</footer>") == want, (a, b)
        assert html_text.main_text(f"<p>date</p>{a}<p>{want[5:]}</p>{z}") == "date\n" + want[5:]
    # names of what is inline in running text, or that only hold such a word, say nothing
    assert html_text.main_text('<article><p class="share-price">9</p><pre>x <span class="hljs-comment">note</span></pre><p><label>L</label> <span class="ad">a</span></p><div class="post-share">s</div></article>') == "9\nx note\nL a"
    # teasers and hidden articles beside the main one stay out
    assert html_text.main_text(f"<article>{story}</article><div class=related><article><p>teaser</p></article></div>") == want
    assert html_text.main_text("<div class=ad>" * 3000 + "deep") == "deep"


def test_deep_pages_with_a_template(spark):
    r = random.Random(43)
    deep = lambda t: f"<article><p>All rights kept by us</p>{'<div>' * 3000}{t}</article>"
    texts = [words_of(r, 40) for _ in range(5)]
    assert read_pages(spark, [deep(t) for t in texts]) == dict(enumerate(texts))
    a = html_text.parse("<div>" * 3000)
    assert html_text.tree_match(a, html_text.parse("<div>" * 3000)) == 3001


# ---- queries and pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables in the driver's layout."""
    at = tmp_path_factory.mktemp("tables")
    rows = [x for x in corpus(80) if x[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(1, "http://a.org/", PAGE)], "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    n = {"op4_chat_format": 2, "op10_main_text": 1}.get(name, len([x for x in corpus(80) if x[0] is not None]))
    assert len(rows) == n
    if name in ORACLES:
        import duckdb

        c = duckdb.connect()
        for t in ("documents", "labels", "conversations", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        q = c.execute(ORACLES[name])
        names = [x[0] for x in q.description]
        want = [tuple(r[names.index(x)] for x in df.columns) for r in q.fetchall()]
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_pipeline(spark, folder):
    """Stage by stage against what brute force says about each stage's own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "pieces":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = common.staged(out, name)
        after = docs.collect()
        if name == "quality_rules":
            assert all(len((r["text"] or "").split()) >= 20 for r in after) and 0 < len(after) < len(before)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
            assert {(r["text"], r["doc_id"]) for r in after} == {(t, i) for t, i in best.items()} and len(after) == len(best)
        elif name == "near_dedup":
            # the stage's contract: five words, a similarity of 0.8 or more, the smallest id stays
            before = sorted(before, key=lambda r: r["doc_id"])
            label = alike_groups([r["text"] for r in before])
            assert {(r["doc_id"], r["text"]) for r in after} == {(before[k]["doc_id"], before[k]["text"]) for k in set(label)} and len(after) == len(set(label))
        elif name == "mixing":
            plan = mixing.mix(spark.createDataFrame(before, docs.schema)).collect()
            assert Counter(r["doc_id"] for r in after) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
        else:
            coder = pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
            texts = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before) and all(coder.decode(np.array(r["ids"])) == texts[r["doc_id"]] and r["n_ids"] == len(r["ids"]) for r in after)


def test_pipeline_leaves_only_its_result(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 0 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["pieces"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, **known):
            self.known, self.conf, self.sparkContext, self.applicationId = known, self, self, "app"

        def get(self, key, default=None):
            return self.known.get(key, default)

    assert common.shared_dir(Session(**{"spark.checkpoint.dir": "hdfs:///x/", "spark.master": "yarn"})) == "hdfs:///x"
    local = Session(**{"spark.master": "local[4]"})
    assert common.shared_dir(local).startswith("file:///") and common.shared_dir(local) == common.shared_dir(local)
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://a:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(**{"spark.master": master}))


def test_pipeline_stages_keep_clashing_columns_and_null_rows(spark, docs, empty, folder):
    """Every stage but the last on rows with nulls, repeats and columns named like the stages' own, and on no rows."""
    odd = docs.withColumns({c: F.lit(7) for c in ("_k_id", "_k_sha", "_k_source", "_copies", "_l_id", "n_words", "set", "bands", "root")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r["_k_id"] == r["_copies"] == r["n_words"] == r["set"] == 7 for r in rows), name
        assert stage(spark, empty, folder).count() == 0, name
    assert corpus_pipeline.encode(spark, empty, folder).count() == 0
