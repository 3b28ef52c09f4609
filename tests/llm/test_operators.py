"""Each operator against a brute-force version, and over awkward tables."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gramscan.llm import bpe, decontam, exact_dedup, html_extract, license_scan, lm_score, minhash, pii, textops, toxicity, warc

TEXTS = [
    None, "", " ", "one", "one two three", "one two three four", "one  two\tthree\n four", "ONE two three four",
    "all rights reserved. CC-BY all rights reserved", "Released under the MIT License.", "x " * 3000, "é ß 漢字 🙂 İ Σ", "a\x1cb\x1fc",
    "card 4111 1111 1111 1111 and 4111111111111112, born 1999-02-29 or 2000-02-29, call +1 (555) 123-4567 from 10.0.0.1, mail a.b@c.example.com",
    "<|endoftext|>odd<|startoftext|>'s it's", "one two three four",
]
EXTRA = "score double, kept boolean, path string, v long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, True, "p", 7) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", 0.5, True, "p", 7), (None, "nobody", 0.5, True, "p", 7)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double")


def test_word_hashes_do_not_depend_on_place():
    h = textops.hash_of(["ab", "b", "ab", "abc"])
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    col = pa.array(["ab", None, "", "x ab"])
    (_, _, w), = textops.word_runs(col)
    assert w.row.tolist() == [0, 3, 3] and w.hash[0] == w.hash[2] == h[0]


def test_exact_dedup(docs, none):
    got = exact_dedup.groups(docs).collect()
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    source = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    size = collections.Counter(t for _, t in source)
    keep = {t: min((i for i, x in source if x == t and i is not None), default=None) for t in size}
    want = sorted((str(i), str(keep[t]), size[t], i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in source)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want
    assert exact_dedup.groups(none).count() == 0


def test_golomb_round_trip():
    for n in (1, 2, 50):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        k, unary, rest = exact_dedup.golomb(x)
        assert (exact_dedup.ungolomb(len(x), k, unary, rest) == x).all()


def components(sets, percent):
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_minhash(spark, docs, none):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 3]
    for group in range(6):
        base = list(rng.choice(vocabulary, 60 + 40 * group))
        for copy in range(12):
            t = list(base)
            for at in rng.integers(0, len(t), copy % 7):
                t[at] = str(rng.choice(vocabulary))
            rows.append((1000 + 100 * group + copy, " ".join(t)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")

    def shingles(t):
        w = words(t, r"[^\x20\x09-\x0D]+")
        return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = {int(i): shingles(t) for i, t in rows}
    want = components(sets, 80)
    got = table(minhash.near_duplicates(df))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert minhash.near_duplicates(none).count() == 0 and minhash.near_duplicates(docs).count() == docs.count()


def test_minhash_of_repeated_ids(spark):
    text = lambda name, other="": " ".join([*(f"{name}{k}" for k in range(60)), other])
    rows = []
    for g in range(0, 200, 10):  # one doc_id with three texts, and near copies of each
        for k in range(3):
            rows += [(g, text(f"g{g}t{k}x", "end")), (g + 1 + k, text(f"g{g}t{k}x", "stop"))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, i // 10 * 10, i % 10 == 0) for i, _ in rows}


def test_minhash_of_null_ids(spark):
    text = " ".join(f"n{k}" for k in range(60))
    rows = [(None, text + " x"), (None, text + " x"), (7, text + " y"), (9, text), (None, "quite another text of no one at all"), (None, "quite another text of no one at all"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("None", "7", False)] * 2 + [("7", "7", True), ("9", "7", False)] + [("None", "None", True)] * 3)


def test_bpe_equals_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = table(bpe.encode(docs, path, with_ids=True))
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(none, path).count() == 0


def test_bpe_merges_equal_brute_force():
    import public_tokenizers

    b = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aaabcdeé") for _ in range(rng.randint(1, 14))) for _ in range(400)] + ["a" * n for n in range(1, 20)]

    def one(w):
        data = w.encode()
        sym = [int(b.inner[x]) for x in data[:-1]] + [int(b.final[data[-1]])]
        while True:
            ranked = [(b.merges[x << 20 | y], k) for k, (x, y) in enumerate(itertools.pairwise(sym)) if x << 20 | y in b.merges]
            if not ranked:
                return sym
            r, k = min(ranked)
            sym[k : k + 2] = [b.made[r]]

    assert b.merge(vocabulary) == [one(w) for w in vocabulary] and b.merge([]) == []
    # a merge that makes a pair of a lower rank than its own: that pair comes first
    small = object.__new__(bpe.Bpe)
    small.inner, small.final = np.arange(256, dtype=np.int32), np.arange(256, dtype=np.int32)
    a, x, y, z, s, t, u = *map(ord, "axyz"), 300, 301, 302
    small.merges = {x << 20 | y: 5, s << 20 | z: 2, z << 20 | x: 7, t << 20 | x: 6}
    small.left, small.right, small.made = [0] * 8, [0] * 8, [0] * 8
    for (key, r), new in zip(small.merges.items(), (s, t, u, 303), strict=True):
        small.left[r], small.right[r], small.made[r] = key >> 20, key & 0xFFFFF, new
    small.pair_keys = np.array(sorted(small.merges), np.int64)
    small.pair_ranks = np.array([small.merges[k] for k in small.pair_keys.tolist()], np.int32)
    b = small
    assert small.merge(["xyzxy", "xyz", "zxy"]) == [one(w) for w in ("xyzxy", "xyz", "zxy")]


def test_licenses(docs, none):
    got = table(license_scan.scan(docs))
    for i, t in enumerate(TEXTS):
        w = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at)) and r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert 0 <= r["score"] <= 1
    assert "mit" in got[9]["labels"] and license_scan.scan(none).count() == 0


def test_automaton():
    a = license_scan.Automaton("copyright [c] <2> all rights")
    run = lambda t: a.accepts(textops.hash_of(t.split()).tolist(), 0)
    assert run("copyright c x y all rights") == 6 and run("copyright all rights") == 3
    assert run("copyright x y z w all rights") is None and run("copyright all right") is None


def regular(template):
    """The template as a regular expression over words, each with a space after it."""
    out, at = "", 0
    for part in re.findall(r"\[|\]|<\d+>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), template)):
        out += "(?:" if part == "[" else ")?" if part == "]" else rf"(?:\S+ ){{0,{part[1:-1]}}}" if part[0] == "<" else part + " "
    return re.compile(r"(?<!\S)" + out)


def test_license_templates_equal_regular_expressions(spark):
    rng = random.Random(8)
    rows = []

    def text_of(template, spoil):
        out, skip = [], 0
        for part in re.findall(r"\[|\]|<\d+>|[^\s\[\]<>]+", template):
            if part == "[":
                skip = rng.random() < 0.5
            elif part == "]":
                skip = 0
            elif not skip:
                out += [f"Name{k}" for k in range(rng.randint(0, int(part[1:-1])))] if part[0] == "<" else [part]
        if spoil:
            k = rng.randrange(len(out))
            out[k : k + 1] = [] if spoil == 1 else [out[k], "other"]
        return " ".join(["Some words before, this is"] + out + ["and after"])

    for template in license_scan.TEMPLATES.values():
        rows += [text_of(template, spoil) for spoil in (0, 0, 0, 1, 1, 2, 2)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = table(license_scan.scan(df))
    forms = {label: regular(t) for label, t in license_scan.TEMPLATES.items()}
    accepted = collections.Counter()
    for k, text in enumerate(rows):
        w = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        line = "".join(x + " " for x in w)
        base = {label for p, label in license_scan.PHRASES.items() if f" {p} " in " " + line}
        own = {label for label, form in forms.items() if form.search(line)}
        accepted.update(own)
        assert got[k]["labels"] == ",".join(sorted(base | own)), text
    assert set(accepted) == set(forms)
    two, three = (next(k for k, x in enumerate(license_scan.TEMPLATES) if x == name) * 7 for name in ("bsd-2-clause-text", "bsd-3-clause-text"))
    assert "bsd-2" in got[two]["labels"] and "bsd-2" not in got[three]["labels"] and "bsd-3" in got[three]["labels"]


def test_decontamination(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    w = item.split()
    more = [(500, " ".join(w[6:] + ["x"] + w[:6])), (501, " ".join(w[:5] + ["x"] * 9)), (502, "y " + item.upper() + " y"), (503, " ".join(w[::-1]))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = table(decontam.find(df, bench))
    assert [got[i]["contaminated"] for i in (500, 501, 502, 503)] == [True, False, True, False]
    assert got[500]["coverage"] == 1 and got[501]["coverage"] == pytest.approx(5 / 12) and got[500]["items"] == [1]
    assert len(got) == len(TEXTS) + 5 and decontam.find(none, bench).count() == 0
    assert not decontam.find(docs, bench.limit(0)).where("contaminated").count()
    assert decontam.keep_clean(df, bench).count() == df.count() - 2


def tiled(text, item, least):
    """Greedy string tiling by trying every pair of places."""
    least, marked = min(least, len(item)), 0
    text, item = list(text), list(item)
    while item:
        best = (0, 0, 0)
        for a, b in itertools.product(range(len(text)), range(len(item))):
            k = 0
            while a + k < len(text) and b + k < len(item) and text[a + k] == item[b + k] is not None:
                k += 1
            if k > best[0]:
                best = (k, a, b)
        k, a, b = best
        if k < least:
            break
        text[a : a + k] = item[b : b + k] = [None] * k
        marked += k
    return marked


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for n in range(150):
        letters = "ab" if n % 2 else "abcde"
        item = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        text = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        for _ in range(3):
            x, at = rng.randint(0, len(item)), rng.randint(0, len(text))
            text[at:at] = item[x : rng.randint(x, len(item))]
        h = textops.hash_of(text) if text else np.zeros(0, np.uint64)
        assert decontam.tiles(h, textops.hash_of(item), 5) == tiled(text, item, 5), (text, item)
    assert decontam.tiles(np.full(20_000, 7, np.uint64), np.full(200, 7, np.uint64), 5) == 200
    assert decontam.tiles(textops.hash_of(list("abcdef")), textops.hash_of(list("abcdef")), 5, lambda i, j: False) == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(k % 37, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 12, 40])))) for k in range(40)] + [(77, "Zeta eta"), (78, "zeta, ETA!"), (None, "omega psi chi")]
    rows = []
    for k in range(80):
        t = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))]
        for _, text in rng.sample(items, 2):
            w = text.split()
            x, at = rng.randint(0, len(w)), rng.randint(0, len(t))
            t[at:at] = w[x : rng.randint(x, len(w))]
        rows.append((k % 70, " ".join(t).upper() if k % 3 else ". ".join(t)))
    rows += [(200, "a zeta eta"), (200, "a zeta eta"), (201, "omega psi chi"), (202, None), (None, "the zeta eta"), (203, "zeta x eta")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    alnum = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want, clean = [], 0
    for i, t in rows:
        w = words(t, alnum)
        cover = [(k, tiled(w, words(x, alnum), 5) / len(words(x, alnum))) for k, x in items if words(x, alnum)]
        top = max(c for _, c in cover)
        best = min(((k is not None, k or 0, k) for k, c in cover if c == top))[2] if top else None
        want.append((i, top >= 0.5, round(top, 9), best, sorted({k for k, c in cover if c >= 0.5 and k is not None})))
        clean += top < 0.5
    got = [(r["doc_id"], r["contaminated"], round(r["coverage"], 9), r["item_id"], list(r["items"])) for r in decontam.find(docs, bench).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontam.keep_clean(docs.withColumn("t", F.lit(1)), bench).count() == clean


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def test_pii(spark, docs, none):
    got = table(pii.pseudonymise(docs, "k"))
    text = got[13]["text"]
    assert "4111 1111" not in text and "4111111111111112" in text and "1999-02-29" in text
    for gone in ("2000-02-29", "123-4567", "10.0.0.1", "a.b@"):
        assert gone not in text
    card = re.search(r"card ([\d ]{19}) and", text)[1]
    assert luhn(card.replace(" ", "")) and card.count(" ") == 3 and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)
    assert got[0]["text"] == "" and got[3]["n_found"] == 0 and got[13]["kinds"] == "card,date,email,ip,phone"
    assert pii.pseudonymise(none, "k").count() == 0
    same = spark.createDataFrame([(1, "ip 10.0.0.1"), (2, "again 10.0.0.1.")], "doc_id long, text string")
    a, b = (re.search(r"\d+(?:\.\d+){3}", r["text"])[0] for r in pii.pseudonymise(same, "k").collect())
    assert a == b
    n = spark.range(189 * 773).select(pii.feistel(F.col("id"), 189, 773, "k", "date").alias("x")).distinct()
    assert n.count() == 189 * 773


def test_pii_formats_and_validity(spark):
    def iban(text):
        t = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1

    kept = ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "DE89 3704 0044 0532 0130 01", "(155) 123-4567", "2001-02-29", "4111111111111112", "300.1.1.1"]
    changed = {
        "123-45-6789": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", "(555) 123-4567": r"\([2-9]\d{2}\) \d{3}-\d{4}", "743-555-3824": r"[2-9]\d{2}-\d{3}-\d{4}",
        "DE89 3704 0044 0532 0130 00": r"DE\d{2}( \d{4}){4} \d{2}", "GB82WEST12345698765432": r"GB\d{2}WEST\d{14}", "MT84MALT011000012345MTLCAST001S": r"MT\d{2}MALT\d{12}MTLCAST\d{3}S",
        "2000-02-29": r"\d{4}-\d{2}-\d{2}", "+49 (30) 1234567": None, "4111-1111-1111-1111": r"\d{4}-\d{4}-\d{4}-\d{4}",
    }
    rows = [*enumerate(kept), *((100 + k, f"so {text}, it is") for k, text in enumerate(changed))]
    got = table(pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    assert [got[k]["text"] for k in range(len(kept))] == kept
    for k, (text, shape) in enumerate(changed.items()):
        new = got[100 + k]["text"]
        assert text not in new and (shape is None or re.fullmatch(f"so {shape}, it is", new)), new
        assert not text[:2].isalpha() or iban(new[3:-7])
    rows = spark.range(20_000).select((F.col("id") * 44_000).alias("v"))
    assert rows.select(pii.feistel(F.col("v"), 898, 99 * 9999, "k", "ssn").alias("x")).where(f"x between 0 and {898 * 99 * 9999 - 1}").distinct().count() == 20_000
    big = spark.range(1000).select((F.lit(10**18 - 1) - F.col("id")).cast("string").alias("d")).select(pii._digits_permuted(F.col("d"), "k", "x").alias("x")).where("length(x) = 18").distinct()
    assert big.count() == 1000


def test_pii_on_very_long_texts(spark):
    n = 1_000_000
    texts = ["x@" + "a." * (n // 2), "a" * n, "1" * n, "1 " * (n // 2), "a.b@" * (n // 4), "." * n, "-" * n, "token" + " " * n, "token=" * (n // 6), "AB12" * (n // 4), "1.1." * (n // 4), "+1 " * (n // 3), "_" * n + "@x.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    begin = time.monotonic()
    got = table(pii.pseudonymise(df, "k"))
    assert len(got) == len(texts) and got[1]["text"] == texts[1] and got[12]["n_found"] == 1
    assert time.monotonic() - begin < 120


def test_warc(spark):
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(1, "http://a/ b", "x"), (2, None, None), (3, "u", odd), (4, "u", "x"), (5, "u", ""), (6, "u", "x" * 100_000)], "page_id long, url string, html string")
    got = table(warc.round_trip(pages), "page_id")
    data = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    first = {}
    for i in sorted(data):
        first.setdefault(data[i], i)
    for i, d in data.items():
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(d), base64.b32encode(hashlib.sha1(d).digest()).decode()) and r["sound"]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[d] == i else ("revisit", first[d]))
    assert len(got) == 6 and warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_across_chunks(spark):
    odd = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    payload = {i: odd * (i % 9) + b"x" * (i * 37 % 900) for i in range(60)}
    rows = spark.createDataFrame([(i, "http://a/", p, None) for i, p in payload.items()], "page_id long, url string, payload binary, refers_to long").coalesce(1)
    for chunk_bytes in (7, 331, 5000):
        chunks = warc.write(rows, archive_bytes=20_000, chunk_bytes=chunk_bytes)
        parts = collections.defaultdict(bytes)
        cut = chunks.orderBy("archive", "offset").collect()
        for r in cut:
            assert len(parts[r["archive"]]) == r["offset"] and len(r["data"]) >= r["own"] and r["own"] <= chunk_bytes
            parts[r["archive"]] += r["data"][: r["own"]]
        assert len(parts) > 1 and any(len(r["data"]) > r["own"] for r in cut)
        assert b"".join(parts[a] for a in sorted(parts)) == b"".join(warc.record(i, "http://a/", p, None) for i, p in payload.items())
        got = warc.read(chunks).collect()
        assert {(r["page_id"], r["n"], r["sound"]) for r in got} == {(i, len(p), True) for i, p in payload.items()} and len(got) == len(payload)


def test_warc_records_are_valid_and_chains_verified(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (3, "u", "same"), (None, None, "same"), (None, "u", ""), (9, "u", None), (9, "v", "other")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, row long").coalesce(1)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in warc.round_trip(pages).collect())
    assert got == sorted([("5", 4, "revisit", "3"), ("3", 4, "response", "None"), ("3", 4, "response", "None"), ("None", 4, "revisit", "3"), ("None", 0, "revisit", "9"), ("9", 0, "response", "None"), ("9", 5, "response", "None")])
    heads = [warc.record(i, "u", b"x", r, n, 0).split(b"\r\n\r\n")[0].decode().split("\r\n") for n, (i, r) in enumerate([(1, None), (1, None), (2, 1)])]
    fields = [dict(line.split(": ", 1) for line in h[1:]) for h in heads]
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= f.keys() and f["WARC-Record-ID"].startswith("<urn:uuid:") for f in fields)
    assert len({f["WARC-Record-ID"] for f in fields}) == 3 and fields[2]["WARC-Refers-To"] == fields[0]["WARC-Record-ID"]
    whole = b"".join(warc.record(i, "u", b"payload" * i, None) for i in range(9))
    schema = "archive string, offset long, own long, data binary"
    pieces = lambda data: [("a", k, min(100, len(data) - k), data[k:]) for k in range(0, len(data), 100)]
    assert warc.read(spark.createDataFrame(pieces(whole), schema)).count() == 9
    for broken in (pieces(whole)[:3] + pieces(whole)[4:], pieces(whole[:-50]), pieces(whole.replace(b"payloadpayload", b"payloadpayloap"))):
        with pytest.raises(Exception, match="archive a: "):
            warc.read(spark.createDataFrame(broken, schema)).count()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav>{}<footer>foot</footer></body></html>"
    same = "This very long boilerplate sentence is on all of the pages here."
    rows = [
        (1, "http://h/1", page.format("<article><h1>A &amp; B</h1><p>one <b>two<br><p class='ad'>buy<p>three\n four</p><section class='comments'><p>c</p></section><script>1<2</script></article>")),
        (2, "http://h/2", page.format(f"<div><p>{same}</p><p>unique words of the second page only</p></div>")),
        (3, "http://h/3", page.format(f"<div><p>{same}</p><p>third page says something else again</p></div>")),
        (4, None, None), (5, "http://h/5", ""), (6, "x", "plain text"), (7, "http://h/7", "<article>cut &am"),
    ]
    got = table(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[1]["text"] == "A & B\n\none two\n\nthree four" and got[2]["text"] == "unique words of the second page only"
    assert got[3]["text"].startswith("third") and [got[i]["text"] for i in (4, 5, 6, 7)] == ["", "", "plain text", "cut &am"]
    assert got[1]["n_chars"] == len(got[1]["text"])


def test_html_of_a_large_host(spark):
    own = lambda i, n: " ".join(f"p{i}x{k}" for k in range(n))
    pages = [[own(i, 12), own(f"{i}y", 3)] for i in range(60)]
    for k in range(0, 60, 2):  # strings and short blocks on two pages each
        for i in (k, k + 1):
            pages[i] += [f"Notice {own(f'n{k}', 9)}", f"Short {k}", own(f"{i}z", 5) + " " + own(f"m{k}", 10)]
    rows = [(i, "http://hot/x", "".join(f"<p>{b}</p>" for b in p)) for i, p in enumerate(pages)] + [(100, "http://cold/x", f"<p>{pages[0][2]}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n\n".join([*p[:2], p[4]]) for i, p in enumerate(pages)} | {100: pages[0][2]}
    for group in (500, 4):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, group=group).collect()} == want, group


def test_html_marks(spark):
    same = "<p>This very long boilerplate sentence is on all of the pages here.</p>"
    heads = ["<!-- <article> -->", "<script>'<main>'</script>", "<nav><article>n</article></nav>", "<p data-x='role=main'></p>", "<i data-role=main></i>", ""]
    rows = [(i, "http://h/", f"{head}{same}<p>own words of page {i} and no others</p>") for i, head in enumerate(heads)]
    rows += [(10 + i, "http://h/", f"<div>gone</div><div {role}>{same}</div>") for i, role in enumerate(["role='main'", "role=main", 'ROLE = "Main"', "class=x role='main'"])]
    got = table(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[i]["text"] for i in range(len(heads))] == [f"own words of page {i} and no others" for i in range(len(heads))]
    assert {got[10 + i]["text"] for i in range(4)} == {same[3:-4]}


def test_html_of_awkward_markup(spark):
    pages = {
        "<main><article class='comment'><p>said a reader</p></article><article class=post><p>the text</p></article></main>": "the text",
        "<article><h1 class='entry-header'>Title</h1><p>text <label>with a label</label></p></article>": "Title\n\ntext with a label",
        '<article><p>one <a href="x>two</a> three</p></article>': "one two three",
        "<div role=main><p>in</p></div><div>out</div>": "in",
        "<article><h2 class='comments'>Comments</h2><p>t</p></article>": "t",
        "a < b and c > d": "a < b and c > d",
    }
    rows = [(k, f"http://h{k}/", h) for k, h in enumerate(pages)] + [(2, "http://h2/", "<article>again</article>"), (None, None, "<article>no id</article>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == sorted([*((str(k), x) for k, x in enumerate(pages.values())), ("2", "again"), ("None", "no id")])
    begin = time.monotonic()
    for page in ("<a " * 300_000 + '"', '<a "' * 200_000, "<" * 500_000, "<p>" * 200_000, "&" * 500_000):
        html_extract.blocks(page)
    assert time.monotonic() - begin < 60


def test_repeated_strings_equal_brute_force():
    rng = np.random.default_rng(4)
    for n in range(60):
        words = rng.integers(0, 4 if n % 2 else 30, 120).astype(np.uint64)
        page = np.sort(rng.integers(0, 6, 120))
        cut = np.flatnonzero(np.diff(page, prepend=page[0]))
        tokens, pages = np.insert(words, cut, np.arange(1000, 1000 + len(cut), dtype=np.uint64)), np.insert(page, cut, page[cut])
        want = np.zeros(len(tokens), bool)
        for i in range(len(tokens) - 2):
            if any(pages[i] != pages[j] and (tokens[i : i + 3] == tokens[j : j + 3]).all() for j in range(len(tokens) - 2)):
                want[i : i + 3] = True
        assert (html_extract.repeated(tokens, pages, 3) == want).all()


def test_suffix_array():
    x = np.array([3, 1, 2, 1, 2, 3, 1, 2], np.uint64)
    assert html_extract.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(5)
    rows, marks = [], []
    for i in range(1200):
        t = [f"w{k}" for k in rng.zipf(1.5, 60) % 500]
        bad = i % 4 == 0
        if bad:
            t[rng.integers(60)] = t[rng.integers(60)] = "nastyword"
        rows.append((i, " ".join(t)))
        marks.append((i, 1, int(bad), 0.0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    model = toxicity.fit(df, lab)
    out = toxicity.score(df, model).join(lab.drop("score"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) > 150 and np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.95
    every = toxicity.score(docs, model)
    assert every.count() == docs.count() and every.where("score between 0 and 1").count() == docs.count()
    assert toxicity.fit(df, lab.limit(0)) is None and toxicity.score(none, None).count() == 0
    assert toxicity.keep_ordinary(docs, model).columns == docs.columns


def test_toxicity_by_pairs_alone(spark):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(400):
        t = [f"w{k}" for k in rng.zipf(1.5, 30) % 100]
        bad = i % 2
        t[10:12] = t[20:22] = ["kettle", "lantern"] if bad else ["lantern", "kettle"]
        rows.append((i, " ".join(t)))
        marks.append((i, 1, bad, 0.0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    model = toxicity.fit(df, lab)
    out = toxicity.score(df, model).join(lab.drop("score"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) > 50 and np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.95
    # a share for each pair and each backoff: the probabilities after a history add up to 1
    v, h = len(model.vocab), model.ids(textops.hash_of(["kettle"]))[0]
    mine = model.pairs // (v + 1) == h
    assert mine.any() and model.pair[:, :-1][:, mine].sum(1) + model.back[:, h] == pytest.approx([1, 1])


def test_toxicity_model_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(300):
        t = [f"w{k}" for k in rng.zipf(1.6, 25) % 60]
        bad = i % 3 == 0
        if bad:
            t[3:5] = ["nasty", "words"]
            t[9] = f"vilest{i}"
        elif i % 2:
            t[7:9] = ["words", "fine"]
        rows.append((i, " ".join(t)))
        marks.append((i, 1, int(bad), 0.0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    model = toxicity.fit(df, lab)
    learned = {r["doc_id"] for r in df.where(~toxicity.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(4)) != 0)).collect()}
    texts = {i: t.split() for i, t in rows if i in learned}
    word, pair, stem = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, t in texts.items():
        word[i % 3 == 0].update(set(t))
        pair[i % 3 == 0].update(set(zip([None, *t], t, strict=False)))

    def shown(n0, n1, odds, m):
        f, n = n1 / (n0 + n1), n0 + n1
        for p, above in ((2 * odds / (1 + 2 * odds), True), (odds / 2 / (1 + odds / 2), False)):
            kl = (f * np.log(f / p) if f else 0) + ((1 - f) * np.log((1 - f) / (1 - p)) if f < 1 else 0)
            if (f > p) == above and f != p and n * kl > np.log(m):
                return True
        return False

    sums = [sum(c.values()) for c in word]
    types = [len(c) for c in word]
    spread = [len(c) for c in pair]
    every = set(word[0]) | set(word[1])
    own = {w for w in every if shown(word[0][w], word[1][w], sums[1] / sums[0], len(every))}
    for i, t in texts.items():
        stem[i % 3 == 0].update({(n, w[:n]) for w in t if w not in own for n in toxicity.STEMS if len(w) >= n})
    all_stems = set(stem[0]) | set(stem[1])
    own_stems = {s for s in all_stems if shown(stem[0][s], stem[1][s], sums[1] / sums[0], len(all_stems))}

    def lower(c, seen, totals):
        return max(seen[c] - 0.75, 0) / totals[c] + 0.75 * types[c] / totals[c] * sum(seen) / sum(totals)

    preds = {w: [sum(x == w for _, x in pair[c]) for c in (0, 1)] for w in every}
    p_word = {w: [lower(c, preds[w], spread) for c in (0, 1)] for w in own}
    p_stem = {s: [lower(c, [stem[0][s], stem[1][s]], sums) for c in (0, 1)] for s in own_stems}
    left = [1 - sum(p[c] for p in [*p_word.values(), *p_stem.values()]) for c in (0, 1)]
    history = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for (h, _), n in pair[c].items():
            history[c][h] += n
    prior = sums[1] / sum(sums)
    both = set(pair[0]) | set(pair[1])
    p_pair = {x: [max(pair[c][x] - 0.75, 0) / (history[c][x[0]] + 5) for c in (0, 1)] for x in both if shown(pair[0][x], pair[1][x], (history[1][x[0]] + prior) / (history[0][x[0]] + 1 - prior), len(both))}
    back = {h: [1 - sum(p[c] for (x, _), p in p_pair.items() if x == h) for c in (0, 1)] for h in [*history[0], *history[1]]}

    def difference(t):
        total = []
        for h, w in zip([None, *t], t, strict=False):
            s = next(((n, w[:n]) for n in toxicity.STEMS if (n, w[:n]) in own_stems and len(w) >= n), None)
            shared = sum(preds[w]) / sum(spread) if w in preds else 1
            p = p_word[w] if w in own else p_stem[s] if s else [x * shared for x in left]
            q = [p_pair.get((h, w), [0, 0])[c] + back.get(h, [1, 1])[c] * p[c] for c in (0, 1)]
            total.append(np.log(q[1] / q[0]))
        return np.mean(total)

    assert own and own_stems and p_pair and len(model.pairs) == len(p_pair)
    some = [t for _, t in rows[:40]] + ["nasty words", "words fine unknownword vilestxyz"]
    ((_, _, w),) = textops.word_runs(pa.array(some), textops.NOT_ALNUM)
    assert model.difference(w) == pytest.approx([difference(t.split()) for t in some], abs=1e-9)
    assert model.curve[1] > 0


def test_toxicity_with_other_ids(spark):
    df = spark.createDataFrame([(f"d{i}", "fine words" if i % 2 else "vile words") for i in range(60)], "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", 1 - i % 2) for i in range(60)], "doc_id string, toxic int")
    assert toxicity.score(df, toxicity.fit(df, lab)).count() == 60


def test_lm_score(spark, docs, none):
    target = spark.createDataFrame([(3,), (5,), (5,), (None,)], "doc_id long")
    got = table(lm_score.score(docs, target))
    every = [(r["doc_id"], words(r["text"], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) for r in docs.collect()]

    def counted(texts):
        word, pair = collections.Counter(), collections.Counter()
        for t in texts:
            word.update(t)
            pair.update(itertools.pairwise(t))
        return word, pair

    k, wanted = lm_score.LEAN, (3, 5)
    tokens = [sum(len(x) for d, x in every if (d in wanted) == of) for of in (True, False)]
    p0, _ = counted([x for _, x in every])
    for i in (4, 5, 8, 9, 10, 11, 13):
        t = next(x for d, x in every if d == i)
        loss = []
        for of in (True, False):
            word, pair = counted([x for d, x in every if (d in wanted) == of and d != i])
            r, total = min(tokens) / tokens[not of], []
            for h, w in zip([None, *t], t, strict=False):
                lower = (r * word[w] + k * p0[w] / p0.total()) / (r * word.total() + k)
                total.append(-np.log((r * pair[h, w] + k * lower) / (r * word[h] + k)))
            loss.append(np.mean(total))
        assert got[i]["ce_diff"] == pytest.approx(loss[0] - loss[1], abs=1e-9) and got[i]["n_tokens"] == len(t)
    assert got[0]["ce_diff"] == got[1]["ce_diff"] == 0 and len(got) == len(TEXTS) + 1
    assert lm_score.score(none, target).count() == 0 and lm_score.score(docs, target.limit(0)).count() == docs.count()


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    documents = spark.read.parquet(f"{d}/documents.parquet")
    docs = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    model = toxicity.fit(documents, spark.read.parquet(f"{d}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(documents, model).where("predicted = 1").collect()}
    left = {i: t for i, t in docs.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub("[ \t-\r]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}

    def shingles(t):
        w = words(t, r"[^\x20\x09-\x0D]+")
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    label = components({i: shingles(t) for i, t in left.items()}, 80)
    left = {i: t for i, t in left.items() if label[i] == i}
    bench = [words(r["text"], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    whole = {i for i, t in left.items() if any(" ".join(b) in " ".join(words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) for b in bench)}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got <= left.keys() - whole and len(left) - len(whole) - len(got) <= 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, d).columns == documents.columns, name
