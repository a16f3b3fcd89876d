"""The training-data operators against plain Python on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from factweave.llm import exact_dedup, mixing, packing, perplexity, pii, quality_rules, queries, sharding, simhash, substrings, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, spans int, row string, __salt int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None, lang="en", source="s"):
    rows = [(i, t, lang, source, None, "x", 1, "r", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def passages():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, short = make(60), make(34)
    out = [None, "", "one two", " ".join(["same"] * 900), " ".join(short), " ".join(short), " ".join(make(35))]
    out += [" ".join(make(rng.randrange(0, 90)) + shared[rng.randrange(0, 12) :] + make(rng.randrange(0, 90))) for _ in range(40)]
    return out + out[-3:] + [" ".join(make(30)) + "\t\n" + " ".join(make(3000))]


def exact_windows(got, texts):
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == substrings.brute_force(texts)


def test_substrings(spark):
    given = passages()
    exact_windows(substrings.remove_repeats(table(spark, given)).collect(), dict(enumerate(given)))


def test_substrings_with_hot_minimisers(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    given = passages()
    exact_windows(substrings.remove_repeats(table(spark, given)).collect(), dict(enumerate(given)))


def test_substrings_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(50)))
    got = substrings.remove_repeats(table(spark, [text, text, text, "a"], ids=[5, 5, None, None])).collect()
    assert sorted(r.n_removed for r in got) == [0, 50, 50, 50]


def test_op6_on_documents(spark, texts):
    got = queries.QUERIES["op6_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substrings.brute_force(texts)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def passes(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
            return 14 <= len(digits) <= 19 and doubled % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    found = [(m.start(), list(BASE).index(k), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


ODD = [
    None, "", "a@b.com@c.de x@y", "mail é a.b+c@d-e.co.uk. z@@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "+1 (714) 555-9345 +1 2", "card 4266 2614 4439 2889 4266261444392889 12",
    "iban DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "ssn 123-45-6789 / 123-45-6789 far", "a" * 50_000 + "@", "9" * 20_000, "+1" + "(" * 20_000, "call 555-123-4567",
]


def test_base_spans(texts):
    for text in [*ODD, *texts.values()]:
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.spans_of(text or "") if s["kind"] in pii.BASE]
        assert base == base_spans(text)


def test_further_spans():
    kinds = lambda t: [s["kind"] for s in pii.spans_of(t)]
    assert kinds(ODD[7]) == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("row 123-45-6789") == [] and kinds(ODD[12]) == ["national_phone"]


def test_op2(spark):
    got = pii.find_pii(table(spark, ODD)).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got} == {i: [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(t or "")] for i, t in enumerate(ODD)}
    assert pii.redact(table(spark, ["x@y.zz and", None])).collect()[0].text == "[email] and"
    for r in queries.QUERIES["op2_personal_data"](spark, SF).limit(5).collect():
        assert len(r.base_sha256) == 64


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [tokens.END] for x in texts]


def test_pieces_and_packing(spark, texts):
    given = [None, "", "a", "a", "Zwölf Boxkämpfer!!", "word, " * 9000, "Don't <|endoftext|> x.", *texts.values()]
    ids = encoded(given)
    got = packing.pack(table(spark, given)).collect()
    wanted = {}
    for i, x in enumerate(ids):
        for p in range(0, len(x), 4096):
            part = x[p : p + 4096]
            wanted[i, p // 4096] = (p, len(part), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in part)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(map(len, ids)) // 4096) + 1


def test_length_histogram(spark, texts):
    counts = Counter(map(len, encoded(texts.values())))
    got = {r.length: r for r in tokens.length_histogram(table(spark, list(texts.values())), span=64).collect()}
    assert {k: r.docs for k, r in got.items()} == counts
    for k, r in got.items():
        assert r.truncated_total == sum(min(k, n) * c for n, c in counts.items())
        assert r.docs_from == sum(c for n, c in counts.items() if n >= k)


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_op8(spark, texts):
    prints = {k: fingerprint(t) for k, t in texts.items()}
    got = queries.QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == components(prints)


@pytest.mark.parametrize("most", [20_000, 6])
def test_links_find_every_component(spark, most):
    rng = random.Random(3)
    prints = []
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(12):
            prints.append(f)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                f ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fingerprint long"), most=most).collect()
    # a link joins a member to the root of its tree at an anchor, so only the components are those of near pairs
    number = {x: i for i, x in enumerate(signed)}
    root = list(range(len(signed)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        x, y = sorted((top(number[r.a]), top(number[r.b])))
        root[y] = x
    assert {i: top(i) for i in range(len(signed))} == components(dict(enumerate(prints)))


def test_near_groups_odd(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(table(spark, [None, "", "a b", "A  b", "q r s t u v"], ids=[4, 3, None, 2, 2])).collect()}
    assert {(4, 3), (3, 3), (None, 2)} <= got


def test_exact_dedup(spark):
    given = table(spark, ["A é", "a é", "a É", None, "", "A é"], ids=[1, 7, 2, 3, 9, None])
    for digest in (exact_dedup.sha256, lambda c: exact_dedup.F.substring(c.cast("binary"), 1, 1)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_report(given, digest=digest).collect()}
        assert got == {1: (7, 3, False), 7: (7, 3, True), None: (7, 3, False), 2: (2, 1, True), 3: (9, 2, False), 9: (9, 2, True)}
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(given).collect()) == [2, 7, 9]


def test_sharding(spark):
    n = 500
    got = sharding.rendezvous_shards(table(spark, [None, "é"] * (n // 2) + ["x"], ids=[*range(n), None]), [1.0] * 24, hot_key=100).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got) and {r.size for r in got} == {8, 10, 9}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mixing(spark):
    rows = [(i, "x" * 10, None, "big" if i < 900 else None, None, "x", 1, "r", 0) for i in range(1000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), {"big": 1.0}).collect()
    assert {r.source for r in out} == {"big"} and 900 <= len(out) <= 1300
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), {"big": 1.0}).collect()
    assert sorted(r.mix_key for r in out) == sorted(r.mix_key for r in again)


def test_quality_rules(spark):
    nav = "home | a | b | c | d\n" * 3 + "z"
    prose = " ".join(f"w{i}." for i in range(40))
    got = {r.doc_id: r for r in quality_rules.clean_lines(table(spark, [None, "", prose, "a b c d e f g h " * 6, nav * 4, prose + "\n" + prose])).collect()}
    assert [got[i].kept for i in range(6)] == [False, False, True, False, False, False]
    assert got[3].n_repeat_words == 48 and got[5].n_dup_lines == 1


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op9_quality_perplexity"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0")
    share = {r.quality: r.s for r in got.join(labels, "doc_id").groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "n").join(got.join(labels, "doc_id").where("kept").groupBy("quality").count(), "quality").selectExpr("quality", "count / n s").collect()}
    assert share[1] >= 0.97 and share.get(0, 0.0) < 0.5


def test_quality_without_labels_or_text(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = perplexity.quality_report(table(spark, [None, "", "abc", "abc"], ids=[1, None, 2, 2], lang=None), labels).collect()
    assert len(got) == 4 and all(r.kept for r in got)
    assert perplexity.quality_filter(table(spark, ["abc"]), labels).count() == 1


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        substrings.remove_repeats(none), pii.find_pii(none), packing.pack(none), tokens.length_histogram(none), simhash.near_groups(none), exact_dedup.dedup_report(none),
        mixing.mix(none), sharding.rendezvous_shards(none, [1.0]), quality_rules.clean_lines(none), perplexity.quality_report(none, labels),
    ):
        assert out.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0
