"""Training-data operators against brute force on small, awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lanecast.llm import exact_dedup, langid, licenses, lm_score, media, mixing, near_dups, packing, queries, secrets, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, lang_pred string"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(6000))
TEXTS = [
    None, "", " \n\t", "a", "A", "The  token=abcdefgh and MIT License, apache license", "The  token=abcdefgh and MIT License, apache license", LONG, LONG + " tail", LONG.upper(), "ｆｕｌｌ ｗｉｄｔｈ ünïcödé 漢字 🙂 <|endoftext|> x", "\x00\x01 nul <p>&amp;</p>",
    "one two three four", "ONE two three four", "one two three four five", "12345 !!!", "AKIA" + "A1" * 9 + " deadbeefdeadbeefdeadbeef secret=token: longvalue1 -----BEGIN RSA PRIVATE KEY-----",
]
ROWS = [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", None, "s3")[k % 4], 0, 7, "x", "y") for k, t in enumerate(TEXTS)] + [(None, "no id", "en", "s1", 0, 7, "x", "y"), (5, TEXTS[5], "en", "s1", 0, 7, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_tokens(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path(tokens.TOKENIZER)
    got = tokens.count_tokens(docs).collect()
    assert len(got) == len(ROWS) and tokens.count_tokens(empty).count() == 0
    for r, g in zip(ROWS, sorted(got, key=lambda g: (g["doc_id"] is None, g["doc_id"])), strict=False):
        text = by_id([{"doc_id": x[0], "text": x[1]} for x in ROWS])[g["doc_id"]]["text"] or ""
        assert (g["n_bytes"], g["n_tokens"]) == (len(text.encode()), tokens.brute_count(text, path)), r
        assert g["over_limit"] == (g["n_tokens"] > 1024)


def test_whole_tokens_are_proved():
    import public_tokenizers

    path = public_tokenizers.path(tokens.TOKENIZER)
    whole = tokens.prove_whole_tokens(path)
    assert 20_000 < len(whole) < 50_257
    assert all(len(tokens.library(path).encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[:500])


def test_faster_encoder_gives_the_librarys_ids():
    import public_tokenizers

    path, ranks = public_tokenizers.path(tokens.TOKENIZER), public_tokenizers.path(tokens.RANKS)
    for t in [t or "" for t in TEXTS] + ["".join(chr(33 + (k * 37 + j) % 540) for j in range(9)) for k in range(500)]:
        assert list(tokens.encode(t, path, ranks)) == tokens.library(path).encode(t, add_special_tokens=False).ids


def test_written_out_classes_are_the_librarys():
    """Every character that takes the shortcut, between letters, digits, spaces and signs."""
    import public_tokenizers

    path, ranks = public_tokenizers.path(tokens.TOKENIZER), public_tokenizers.path(tokens.RANKS)
    tok, wide = tokens.library(path), tokens.needs_library(path)
    texts = [f"a{c}b 1{c}2 {c} !{c}? {c}{c}  {c}\n" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if not wide.search(c)]
    assert len(texts) > 30_000
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in tokens.pre_tokens(text)) == len(e.ids), ascii(text)
        assert list(tokens.encode(text, path, ranks)) == e.ids


def test_packing(docs, empty):
    import public_tokenizers

    tok = tokens.library(public_tokenizers.path(tokens.TOKENIZER))
    got = packing.pack(docs, shard_docs=4).collect()
    assert packing.pack(empty).count() == 0
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in ROWS}
    covered, sequences = Counter(), {}
    for p in got:
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and len(piece) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        covered[p["doc_id"]] += p["length"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert covered == Counter({k: len(v) * (2 if k == 5 else 1) for k, v in ids.items()})
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024


def test_packing_pads_less_than_one_sequence():
    lengths = [(k * 7919) % 1023 + 1 for k in range(500)]
    used = Counter()
    for _, _, n, s, _, _ in packing.assign(lengths, 1024, 1.0, 1 / 1024):
        used[s] += n
    assert sum(used.values()) == sum(lengths) and len(used) == -(-sum(lengths) // 1024) and max(used.values()) <= 1024


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, "test_digests")
    got = exact_dedup.dedup(docs, index, "one").collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for k, t, *_ in ROWS:
        groups.setdefault(low(t), []).append(k)
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    digest = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        g = digest[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["keep_id"] == max((x for x in g if x is not None), default=None)
    again = exact_dedup.dedup(docs.where("doc_id < 3"), index, "two")
    assert again.where("kept").count() == 0 and index.rows().count() == len(groups)
    assert exact_dedup.keep_one(docs, exact_dedup.DigestIndex(spark, "test_digests_2")).count() == len(groups)
    assert exact_dedup.dedup(empty, exact_dedup.DigestIndex(spark, "test_digests_3"), "one").count() == 0


def test_exact_dedup_batch_runs_again_and_in_another_session(spark, docs):
    index = exact_dedup.DigestIndex(spark, "test_digests_4", buckets=3)
    first = docs.where("doc_id < 6")
    rows = lambda d: sorted(map(str, d.collect()))
    want = rows(exact_dedup.dedup(first, index, "monday"))
    assert rows(exact_dedup.dedup(first, index, "monday")) == want  # whatever was read of the first run is lost
    other = exact_dedup.DigestIndex(spark.newSession(), "test_digests_4")
    exact_dedup.dedup(other.spark.createDataFrame([(77, "Brand new"), (78, "brand new"), (79, "A")], "doc_id long, text string"), other, "tuesday").collect()
    assert other.buckets == 3 and other.rows().groupBy("batch").count().where("batch = 'tuesday' AND count = 1").count() == 1
    assert rows(exact_dedup.dedup(first, index, "monday")) == want
    index.drop()


def test_stages_keep_clashing_columns(spark):
    names = ["doc_id", "text", "source", "doc", "digest", "copies", "nth", "node", "bucket", "__id", "__copies"]
    d = spark.createDataFrame([(k, f"some words of a text {k % 3} {'x ' * k}", "s", *map(str, range(8))) for k in range(6)] + [(1, "some words of a text 1 x ", "s", *map(str, range(8)))], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    index = exact_dedup.DigestIndex(spark, "test_digests_5")
    for out in (exact_dedup.keep_one(d, index), near_dups.keep_one(d), mixing.take(d)):
        assert out.columns == names and all(r["digest"] == "1" and r["__id"] == "6" for r in out.collect())
    index.drop()


def test_near_duplicates(spark, docs, empty):
    base = [f"v{k}" for k in range(120)]
    more = [(100 + k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 120, 3)] + [(300 + k, " ".join(base[k:] + [f"u{j}" for j in range(k)])) for k in range(0, 60, 2)]
    rows = [(k, t) for k, t, *_ in ROWS if k is not None and k != 5] + [(5, TEXTS[5])] + more
    want = near_dups.brute_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 40
    assert near_dups.near_duplicates(docs).count() == len(ROWS) and near_dups.near_duplicates(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dups.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {201: 200}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(empty).count() == 0
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, *_ in ROWS}
    assert all(r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(g[0]["target"] for g in by_source.values()) - 1.5 * total) < 1e-6 * total
    for g in by_source.values():
        assert g[0]["target"] <= 2 * g[0]["source_size"] + 1e-6 and abs(sum(r["taken"] for r in g) - g[0]["target"]) <= 3 * mixing.BLOCK + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.take(docs).columns == docs.columns


def test_sainte_lague_is_highest_quotients(spark):
    votes = [53, 24, 23, 0, 7, 7]
    d = spark.createDataFrame([("g", k, v, 20) for k, v in enumerate(votes)], "g string, k int, v long, seats long")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(d, ["g"], ["k"], "v", "seats").collect()}
    want = Counter(k for _, k in sorted(((-v / (2 * n - 1), k) for k, v in enumerate(votes) for n in range(1, 30) if v))[:20])
    assert got == {k: want[k] for k in range(6)}


def brute_spans(rule, text):
    out = []
    for m in re.finditer(rule.regex, text, re.IGNORECASE if rule.fold else 0):
        if len(m[rule.group]) >= rule.least:
            out.append((m.start(), m.end()))
    return out


def test_secrets(docs, empty):
    got = secrets.scan(docs).collect()
    texts = {k: t or "" for k, t, *_ in ROWS}
    assert len(got) == len(ROWS) and secrets.scan(empty).count() == 0
    for r in got:
        for rule in secrets.RULES:
            assert [tuple(s) for s in r[rule.kind]] == brute_spans(rule, texts[r["doc_id"]])
    assert any(len(r["assign"]) for r in got) and any(len(r["private_key"]) for r in got)


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.regex) for r in secrets.RULES}
    assert q["hex"] == [] and q["access"] == [{"aki", "kia"}]
    assert {"tok", "oke", "ken"} in q["assign"] and {"sec", "ecr", "cre", "ret"} in q["assign"]


def test_licenses(docs, empty):
    got = licenses.scan_licenses(docs).collect()
    texts = {k: t or "" for k, t, *_ in ROWS}
    assert len(got) == len(ROWS) and licenses.scan_licenses(empty).count() == 0
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        starts = [(k, t.label) for t in licenses.TEMPLATES if t.base for k in range(len(words)) if words[k : k + len(t.text.split())] == t.text.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(starts), ",".join(sorted({x for _, x in starts})))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in starts), default=None), max((k for k, _ in starts), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_whole_licence_texts(spark):
    whole = {"mit-whole": licenses._GRANTED, "bsd-3-clause-whole": licenses._CLAUSES_2 + licenses._CLAUSE_3 + licenses._DISCLAIMED, "bsd-2-clause-whole": licenses._CLAUSES_2 + licenses._DISCLAIMED, "gpl-3.0-notice": licenses._GPL}
    texts = [f"Copyright (c) 2020 x\n\n{t}\n\nint main() {{}}" for t in whole.values()] + [" ".join(licenses._GRANTED.split()[:40])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {x for x in r["labels"].split(",") if x in whole} for r in licenses.scan_licenses(d).collect()}
    assert got == {**{k: {name} for k, name in enumerate(whole)}, len(whole): set()}  # a file with the first lines alone has no whole text


def test_licences_equal_brute_force(spark):
    """Labels and score by trying every template at every word."""
    t = licenses.TEMPLATES
    texts = [f"// x {a.text} y {a.key}" for a in t] + [" ".join(a.text.split()[1:]) for a in t] + [t[4].text.replace("person", "body") + " mit mit license", "license mit apache general public", None, " ".join(a.text for a in t) * 2]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {k: (x or "").lower().replace("//", " ").split() for k, x in enumerate(texts)}
    seen = Counter(w for ws in words.values() for w in set(ws) if any(w in a.text.split() for a in t))
    idf = lambda w: 1.0 + math.log((1 + max(seen.values())) / (1 + seen[w]))
    for r in licenses.scan_licenses(d).collect():
        ws, labels, score = words[r["doc_id"]], set(), 0.0
        for a in t:
            text, key = a.text.split(), a.key.split()
            at = next(k for k in range(len(text)) if text[k : k + len(key)] == key)
            for start in range(-at, len(ws)):
                if ws[max(0, start + at) : start + at + len(key)] != key:
                    continue
                share = sum(idf(w) for k, w in enumerate(text) if 0 <= start + k < len(ws) and ws[start + k] == w) / sum(map(idf, text))
                score = max(score, share)
                labels |= {a.label} if a.base or share >= licenses.COVER else set()
        assert r["labels"] == ",".join(sorted(labels)) and abs(r["score"] - score) < 1e-9, (r, labels, score)


def test_secrets_by_shuffled_join_and_many_matches(spark, docs):
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(secrets.scan(docs, small=0)) == rows(secrets.scan(docs))
    text = " ".join(f"{k:024x}" for k in range(300)) + " token=abcdefgh"
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert all([tuple(s) for s in got[r.kind]] == brute_spans(r, text) for r in secrets.RULES) and len(got["hex"]) == 300


def test_media_hot_digest_missing_payload_and_clashing_columns(spark):
    sequence = lambda *digests: [(k, "media", None, d, f"c{k}") for k, d in enumerate(digests)]
    pages = spark.createDataFrame([(1, "x", sequence("a", "a", "b")), (2, "y", sequence("a", "lost", None)), (3, "z", [])], f"page_id long, feature string, sequence {media.SEQUENCE}")
    store = spark.createDataFrame([("a", 64, "h", 1, 70, "fa"), ("a", 64, "h", 1, 70, "fa"), ("b", 64, "i", 2, 71, "fb")], media.FEATURES)
    want = [(1, 0, "c0", "a", "fa"), (1, 1, "c1", "a", "fa"), (1, 2, "c2", "b", "fb"), (2, 0, "c0", "a", "fa"), (2, 1, "c1", "lost", None), (2, 2, "c2", None, None)]
    for hot_share in (1000, 3, 1):  # all hot, one hot, none
        got = media.resolve(pages, store, hot_share).select("page_id", "position", "caption", "media_sha256", "feature")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want


def test_media(docs, empty):
    rows = docs.select("doc_id", "text")
    made = media.media_of(rows)
    found = media.resolve(media.interleave(made.select("doc_id", "n_bytes", "html")), media.read_back(made.select("media_digest", "media")))
    got, texts = found.collect(), {k: t or "" for k, t, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        data = texts[r["doc_id"]].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["caption"] == f"document {r['doc_id']}" and r["position"] == (1 if data else 0)
    assert media.media_of(empty.select("doc_id", "text")).count() == 0


def test_interleaving_keeps_order_and_captions():
    page = '<p>one</p><figure><img src="media:aa" alt="x"><figcaption>cap &amp; tion</figcaption></figure>two<img src="media:bb" alt="alt"><script>no</script>three'
    got = [(i["kind"], i["text"], i["digest"], i["caption"]) for i in media.parse_page(page)]
    assert got == [("text", "one", None, None), ("media", None, "aa", "cap & tion"), ("text", "two", None, None), ("media", None, "bb", "alt"), ("text", "three", None, None)]


def test_a_caption_may_stand_before_its_media():
    page = '<figure><figcaption>c</figcaption><img src="media:a"><img src="media:b" alt="x"></figure><img src="media:d" alt="y"><figure><img src="media:e">'
    assert [(i["digest"], i["caption"]) for i in media.parse_page(page)] == [("a", "c"), ("b", "c"), ("d", "y"), ("e", None)]


def test_language_id(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(d.where("doc_id % 2 = 0").select("lang", "text"))
    got = langid.identify(d.where("doc_id % 2 = 1"), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = by_id(langid.identify(docs, model).collect())
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["rejected"] for k in (0, 1, 2, 15)) and langid.identify(empty, model).count() == 0
    assert langid.fit(empty.select("lang", "text")) == {}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() < len(ROWS)


def test_suffix_tree_scores(docs, empty):
    training = docs.where("doc_id % 2 = 0")
    got = lm_score.score(docs, training).collect()
    c, texts = Counter(), {k: t or "" for k, t, *_ in ROWS}
    words = lambda t: [*t.encode().lower().split(), None]
    for k, t in texts.items():
        if k is not None and k % 2 == 0:
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(ROWS)
    for r in got:
        w = words(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 and r["score"] < 0
    assert lm_score.score(empty, training).count() == 0 and lm_score.score(docs, empty).first()["train_tokens"] == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    docs = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, SF)
        docs = corpus_pipeline.stored(docs, name)
        assert docs.columns == d.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {c for _, c in near_dups.brute_force(rows).values()} == {k for k, _ in rows}
    assert docs.count() > 0.7 * d.count()
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] > 0
