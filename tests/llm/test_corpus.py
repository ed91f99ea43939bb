"""The corpus operators against plain versions, the tokenizers library, round trips and odd rows."""

import array
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tests.conftest import SF, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightfield.llm import bpe, debruijn, decontaminate, licenses, nearcopies, quality, queries, secrets, suffixes, tokenfile, warc
from tests.llm import brute

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def corpus(seed=3):
    """Copies with edits, odd keys, empty, null, long and repetitive texts, an extra column with a clashing name."""
    rnd = random.Random(seed)
    base = [[rnd.choice(["a", "bé", "cc", "d", "e"]) + str(rnd.randrange(50)) for _ in range(500)] for _ in range(3)]
    docs = [(None, None), (1, ""), (2, "x" * 700), (3, "x\t" * 200), (4, " ".join(base[0])), (4, " ".join(base[0])), (None, " ".join(base[1][:200])), (-5, " ".join(base[1]))]
    for _ in range(30):
        b = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            b[rnd.randrange(len(b))] = "zz"
        s = rnd.randrange(300)
        docs.append((rnd.randrange(100), rnd.choice([" ", "\n", "  "]).join(b[s : s + rnd.randint(10, 300)] + ["q%d" % rnd.randrange(9) for _ in range(rnd.randint(0, 40))])))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)).repartition(3)
    return rows, df


def test_bytes_repeats(docs):
    rows, df = docs
    got = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df).collect()), key=str)
    assert got == brute.repeats(rows, 200)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_word_repeats(docs):
    rows, df = docs
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in debruijn.remove_earlier(df).collect()), key=str)
    assert got == brute.earlier(rows, 50)
    assert debruijn.remove_earlier(df.limit(0)).count() == 0


def test_near_copies(docs):
    rows, df = docs
    got = sorted(((r.doc_id, r.class_id) for r in nearcopies.near_copies(df).collect()), key=str)
    want = brute.near(rows)
    assert got == want
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns and kept.count() <= len(rows)
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_probability_jaccard():
    rnd = random.Random(1)
    for _ in range(50):
        x, y = (Counter({i: rnd.randint(1, 4) for i in rnd.sample(range(30), 12)}) for _ in range(2))
        arr = lambda d: (np.array(sorted(d)), np.array([d[i] for i in sorted(d)]))
        assert abs(nearcopies.probability_jaccard(*arr(x), *arr(y)) - brute.probability_jaccard(x, y)) < 1e-9


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 1200).astype(np.uint64)
    text = np.concatenate([np.zeros(1000, int), np.ones(1000, int)])
    s = nearcopies.signatures(text, np.concatenate([h[:1000], h[200:]]), np.ones(2000), 2, 2048)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


POOL = st.text(alphabet=st.sampled_from("abcXYZ'sStTdDÀéßİΣσς1²½٣一ⅷ \t\n\x0b\x1c\x85 　.,!<|>_-🙂́각ᄀ"), max_size=40)
SPECIAL = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL"])


@settings(max_examples=300, deadline=None)
@given(st.lists(POOL | SPECIAL, max_size=6))
def test_bpe_matches_library(library, parts):
    text = "".join(parts)
    want = library.encode(text, add_special_tokens=False).ids
    ours = bpe.encoder(VOCABULARY)
    ids = ours.encode([text])[0]
    assert array.array("I", ids).tolist() == want
    assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_long_words(library):
    text = "a" * 3000 + " " + "ab" * 2000 + "=" * 2500
    assert array.array("I", bpe.encoder(VOCABULARY).encode([text])[0]).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_operator(docs, library):
    rows, df = docs
    got = sorted((tuple(array.array("I", bytes(r.token_ids))), r.decoded, r.spans) for r in bpe.bpe_encode(df, VOCABULARY).collect())
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert got == sorted((tuple(i), library.decode(i, skip_special_tokens=False), 1) for i in want)
    assert bpe.bpe_encode(df.limit(0), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 60000), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, escapes = tokenfile.pack(v)
    assert tokenfile.unpack(words, escapes, len(v)).tolist() == values


def test_token_files(spark, docs, library):
    rows, df = docs
    made = tokenfile.token_files(df, VOCABULARY, roll_ids=2000)
    got = tokenfile.crc32(tokenfile.read_token_files(spark, made)).orderBy("start").collect()
    ordered = sorted(((d is not None, d or 0, t is not None, t or ""), d, t) for d, t in rows)
    start, want = 0, []
    for _, d, t in ordered:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    empty = tokenfile.token_files(df.limit(0), VOCABULARY)
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_quality(spark, duck):
    ours, theirs = same(queries.op4_quality(spark, SF), duck, queries.SQL["op4_quality"])
    assert ours == theirs


def test_quality_odd_rows(docs):
    rows, df = docs
    got = quality.quality_report(df).collect()
    assert len(got) == len(rows)
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality.keep_good(df.limit(0)).count() == 0


def test_warc(spark, duck):
    ours, theirs = same(queries.op5_warc(spark, SF), duck, queries.SQL["op5_warc"])
    assert ours == theirs


def test_warc_odd_rows(spark):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (None, "u", big), (2, "again", big), (3, "u", None), (4, "u", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", "b" * 999), (7, "u", "b" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    root = warc.write_warc(pages, roll_bytes=600)
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 1200}
    assert by == {(1, "revisit", 2), (2, "response", None), (None, "revisit", 2)}
    assert sum(r.record_type == "revisit" for r in got) == 2
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX:%20y"}
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, t.label) for t in licenses.PHRASES for i in range(len(words)) if words[i : i + len(t.text.split())] == t.text.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    notice = licenses.NOTICES[2].text
    texts = [None, "", "Under the MIT License. under the mit license", "cc-by-nc CC BY NC é", "APACHE license\nversion 2 x", notice.replace("binary", "any"), "under the mit", notice[:60], "Under  the MIT License", "mit " * 5000 + "under the mit license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = licenses.license_labels(df).collect()
    ours = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert ours == sorted(((d, *plain_licenses(t)) for d, t in rows), key=str)
    assert {r.doc_id: r.labels for r in got if r.doc_id is not None}[5] == "bsd"
    assert all(0 <= r.score <= 1 for r in got) and licenses.license_labels(df.limit(0)).count() == 0


def test_decontamination(spark):
    """Passages of 2 to 250 characters with edits around the budget against the least edits between them and any part of the text."""
    rnd = random.Random(5)
    words = ["the", "inea", "onrein", "thhe", "ertion", "nd", "wh", "st", "able", "es"]
    say = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    show = lambda t: "".join(map(chr, decontaminate.normal(t)))
    passages = [say(rnd.randint(2, 30)) for _ in range(60)] + ["ab " * 30, "x" * 90, "no 7", "yes", "?!", "z"]
    docs, want = [], {}
    for k, passage in enumerate(passages):
        chars = list(show(passage))
        most = decontaminate.budget(len(chars)) if len(chars) >= decontaminate.Q else 0
        for _ in range(rnd.randint(0, int(1.6 * most) + 1) if len(chars) > 9 else 0):
            i, kind = rnd.randrange(len(chars)), rnd.random()
            if kind < 0.34:
                chars[i] = "q"
            elif kind < 0.67:
                chars.insert(i, "y")
            else:
                del chars[i]
        text = f"{say(rnd.randint(0, 40))}. {''.join(chars).upper()}! {say(rnd.randint(0, 40))}"
        docs += [(k, text), (k, text)]
        for i in (k, *rnd.sample(range(len(passages)), 2)):
            p = show(passages[i])
            least = brute.edits(p, show(text)) if p else None
            most = decontaminate.budget(len(p)) if len(p) >= decontaminate.Q else 0
            if p and (most or len(p) >= decontaminate.Q):
                want[k, i] = least if least <= most else None
            else:
                want[k, i] = 0 if p and f" {p} " in f" {show(text)} " else None
    docs += [(None, None), (900, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("TID", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(passages), (100, passages[0]), (101, None)], "item_id long, text string")
    found = decontaminate.contaminated(df, bench).collect()
    got = {}
    for r in found:
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert {k: got.get(k) for k in want} == want
    assert sum(v is not None for v in want.values()) > 20 < sum(v is None for v in want.values())
    assert got.get((0, 100)) == got.get((0, 0))
    each = Counter((r.doc_id, r.item_id, r.start) for r in found)
    assert all(n % 2 == 0 for n in each.values())  # repeated rows each report
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    long = {i for i, p in enumerate(passages) if len(show(p)) >= decontaminate.Q} | {100}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in docs if d is not None and not any((d, i) in got for i in long))
    assert decontaminate.contaminated(df.limit(0), bench).count() == decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df.limit(0), bench).count() == 0


def test_decontamination_of_repetitive_texts(spark):
    """A passage of one repeated word against a long text of the same word; both are periodic, so that every q-gram meets hundreds of places."""
    bench = spark.createDataFrame([(1, "la di " * 100), (2, "do re mi fa so la ti and then something else again")], "item_id long, text string")
    df = spark.createDataFrame([(1, "la di " * 8000), (2, "la di " * 60), (3, "x " * 50000 + "do re mi fa so la ti and then something else again")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 1), (3, 2)}


def test_decontamination_in_pieces(monkeypatch):
    """Texts scanned in pieces give the same q-grams as whole ones."""
    import pyarrow as pa

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ab", "cde", "f"]) for _ in range(3000)), "", "ab cde"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["tid", "text"])
    bitmap = np.full(4, 0xF0F0F0F0F0F0F0F0, np.uint64)
    run = lambda: sorted({tuple(r.values()) for b in decontaminate._scan(bitmap, 15, [2], 12)([batch]) for r in b.to_pylist() if True})
    whole = run()
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    assert len(whole) > 1000
    # a short passage is named at its first place in each piece
    assert {r for r in run() if r in set(whole)} == set(whole)


def plain_secrets(text):
    text = text or ""
    out = []
    for k, (pattern, least, group) in enumerate(((r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(spark):
    rnd = random.Random(7)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "=", ": ", '"', "'", "AKIA", "ABCDEFGH1234567", "abc", "0123456789abcdef", "é", " ", "\n", "x.y/z+longvalue", "ſecret", "K", "ghp_Ab3dE5fG7hJ9kL1mN3pQ5rS7"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + [None, "", "a" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    got = {r.doc_id: [(s.start, secrets.KINDS.index(s.kind), s.end) for s in r.secrets] for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 3] == plain_secrets(t)
        assert got[i] == sorted(got[i])
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert all(clean[i] == t if not got[i] else "[SECRET]" in clean[i] for i, t in enumerate(texts))


def test_entropy_spans():
    table = secrets._entropy_table(20)
    assert secrets.high_entropy("a" * 40, 20, 1.0, table) is None
    assert secrets.high_entropy("abcdefghijklmnopqrst", 20, 4.3, table) == (0, 20)
    assert secrets.high_entropy("short", 20, 0.0, table) is None


def test_random_keys_of_all_classes():
    rnd, bits, table = random.Random(3), secrets.bounds(), secrets._entropy_table(20)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    find = lambda t: secrets.find_secrets(t, 20, bits, table)
    # share missed of keys of 20 characters: MISS by the bound, and keys without a digit (see the module)
    for alphabet, most in ((lower + digits, 0.013), (upper + "234567", 0.03), (upper + digits, 0.013), (lower + upper + digits, 0.013), (digits + "abcdef", 0.0), (digits + "ABCDEF", 0.01)):
        keys = ["".join(rnd.choices(alphabet, k=20)) for _ in range(3000)]
        assert sum(not find(f"see {k} here") for k in keys) <= most * len(keys), alphabet
        assert sum(not find("MY_NAME=" + k) for k in keys) <= (most + 0.03) * len(keys), alphabet  # NAME=letters is on the allow list
    for plain in ("how-to-install-python3-on-ubuntu-22-and-24", "REPORT_2024_QUARTER_3_FINAL_VERSION", "internationalizationandlocalization", "parseHTTPResponseIntoJSONDocument", "docs/user/guide/chapter12"):
        assert find(plain) == [], plain
    assert secrets.least_bits(2, 2, 0.4) == 0.0 and secrets.least_bits(2, 2, 0.5) == 1.0


def test_pipeline(spark):
    import corpus_pipeline

    source = queries.table(spark, SF, "documents")
    docs = source
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        assert i == 4 or docs.columns == source.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = {r.doc_id: r.text for r in source.collect()}
    good = {r.doc_id for r in quality.quality_report(source).collect() if r.kept}
    bench = [decontaminate.normal(r.text).tobytes() for r in queries.table(spark, SF, "benchmark").collect()]
    held = brute.near([(d, t) for d, t in rows.items() if d in good])
    first = {c for _, c in held}
    want = {d for d in first if not any(b in decontaminate.normal(rows[d]).tobytes() for b in bench)}
    assert ids == want


def test_hot_bucket_keeps_all_links(spark):
    """A chain of copies in one bucket, of which few resemble the pivot."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, now = [], [rnd.choice(words) for _ in range(120)]
    for i in range(60):
        now = list(now)
        now[rnd.randrange(len(now))] = rnd.choice(words)
        docs.append((i, " ".join(now)))
    got = sorted(((r.doc_id, r.class_id) for r in nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute.near(docs)


def test_shingles_of_the_texts_asked_for_alone(spark):
    """What the sketch lets pass wrongly, one text in 16 where it is full, is not spread into shingles."""
    rows = nearcopies._texts(spark.range(60000).selectExpr("id", "concat('text ', id) AS text"), "id", "text")
    tids = rows.where("doc < 4000").select("tid")
    assert nearcopies._shingled(rows, tids, 5).count() == 4000
