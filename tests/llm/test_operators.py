"""Every training-data operator against brute force, and on the rows that usually break things."""

import hashlib
import math
import random
import re
import wave
import zlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import types as S

from corpusloom.llm import bpe, decontaminate, hilbert_shards, language_id, line_dedup, lm_score, media, near_dedup, pii, warc
from corpusloom.llm.common import bound_batches

DOCS = S.StructType([S.StructField("doc_id", S.LongType()), S.StructField("text", S.StringType()), S.StructField("lang", S.StringType()), S.StructField("source", S.StringType()), S.StructField("n_chars", S.LongType()), S.StructField("_id", S.StringType()), S.StructField("kept", S.StringType()), S.StructField("n", S.StringType())])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zeta", "éta", "theta", "iota", "kappa", "x1", "mu"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(12) for _ in range(3)]
    base = line(60)
    out = [None, "", "   \n\t ", "one", "a b c d", base, base, base.replace("x1", "x2", 1), base + "\nend", line(4000)]
    out.append(line(60_000))  # very long
    for n in range(40):
        parts = [line(rng.randint(1, 14)) for _ in range(rng.randint(1, 6))]
        out.append("\n".join([*parts, " " + shared[n % 3].upper() + "\t"] if n % 2 else parts))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "fr" if i % 3 else "en", f"s{i % 4}", len(t or ""), "clash", "clash", None) for i, t in enumerate(texts)]
    rows += [(None, texts[5], None, None, None, None, None, None), (7, texts[7], "en", "s3", 3, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def every(texts):
    """(id, text) of every row of ``docs``: a null id and an id of two equal rows among them."""
    return [*enumerate(texts), (None, texts[5]), (7, texts[7])]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    """Rows by their ids, which must be unique."""
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: r for r in rows}


def in_order(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id))


def in_order_of_ids(every):
    return sorted(every, key=lambda e: (e[0] is None, e[0]))


def test_line_dedup(docs, texts, empty):
    found = line_dedup.dedup_lines(docs, min_docs=5).collect()
    key = lambda line: lower(line.strip(" \t\n\r\x0b\x0c"))
    every = [*enumerate(texts), (None, texts[5]), (7, texts[7])]
    where: dict = {}
    for i, t in every:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40 and i is not None:
                where.setdefault(k, set()).add(i)
    keeper = {k: max(v) for k, v in where.items() if len(v) >= 5}
    assert keeper
    want = []
    for i, t in every:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found) == Counter(want)
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("heavy_rows", [2, 1000])
def test_line_dedup_counts_ids_once(spark, monkeypatch, heavy_rows):
    import duckdb

    from corpusloom.llm import common, queries

    monkeypatch.setattr(common, "HEAVY_ROWS", heavy_rows)
    a, b, c = "a" * 40, "b" * 45, "ß" * 40
    rows = [*((1, f"{a}\n{k}") for k in range(4)), (2, a), *((10 + k, f"{b}\n {b.upper()}\t\n{c}") for k in range(5)), (14, b), (None, f"{b}\nx"), *((20 + k, "c" * 39 + "\n" + a) for k in range(2)), (3, "long " * 60_000 + "\n" + b)]
    df = spark.createDataFrame([(i, t, "x", "y", 9) for i, t in rows], "doc_id long, text string, _drops string, _DROP_ID string, n_chars int")
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(df).collect())
    def cut(i, t):
        kept = [x for x in t.split("\n") if not (x.strip().lower() == b and i != 14 or x == c and i != 14)]
        return i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept)
    assert got == Counter(cut(i, t) for i, t in rows)
    con = duckdb.connect()
    con.register("documents", df.dropDuplicates(["doc_id"]).toPandas())
    twin = Counter(con.sql(f"select doc_id, n_lines, n_dropped from ({queries.OP2_SQL})").fetchall())
    assert twin == Counter((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df.dropDuplicates(["doc_id"])).collect())
    out = line_dedup.replace_text(df)
    assert out.schema == df.schema and Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, k) for i, _, _, k in got.elements())


def test_replace_text_keeps_columns(docs):
    out = line_dedup.replace_text(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.doc_id is not None and r.doc_id > 9 and r.text)


def test_near_dedup(docs, texts, every, empty):
    sets = shingle_sets(texts)
    want = groups_of(range(len(texts)), sets)
    got = near_dedup.near_duplicates(docs).collect()
    rows = [(i, len(sets[5 if i is None else i]), None if i is None else want[i], i is None or want[i] == i) for i, _ in every]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def groups_of(ids, sets):
    """Smallest id reachable, by trying all pairs; documents are named by their ids, which may repeat."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, x) in enumerate(zip(ids, sets, strict=True)):
        for j, y in zip(ids[:n], sets[:n], strict=True):
            if (both := len(x & y)) and 100 * both >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def loose_groups(rng):
    """Bodies whose copies differ by growing shares of their words, so that some link, some link by others alone and some don't."""
    rows = []
    for body in range(2):
        words = [f"b{body}w{rng.randint(0, 400)}" for _ in range(150)]
        rows += [" ".join(f"x{rng.randint(0, 10**6)}" if rng.random() < n / 1200 else w for w in words) for n in range(70)]
    rows += [rows[3]] * 20 + [f"{rows[5]} {rows[90]}", " ".join(f"{w}!" for w in rows[0].split()) * 30]
    return rows


@pytest.mark.parametrize("small_slices", [False, True])
def test_near_dedup_of_loose_groups(spark, monkeypatch, small_slices):
    from pyspark.sql import functions as F

    from corpusloom.llm import common

    if small_slices:
        for module, name, value in ((near_dedup, "SLICE_ROWS", 12), (near_dedup, "SLICE_BYTES", 40_000), (common, "HEAVY_ROWS", 6)):
            monkeypatch.setattr(module, name, value)
    rows = list(enumerate(loose_groups(random.Random(11)), 100))
    rows += [(100, rows[100][1]), (7, rows[40][1]), (7, rows[120][1]), (7, rows[40][1])]  # ids of several texts
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (None, None)], "doc_id long, text string").repartition(4)
    want = groups_of([i for i, _ in rows], shingle_sets([t for _, t in rows]))
    assert 4 < Counter(want.values()).most_common(1)[0][1] and sum(want[i] == i for i in want) > 20
    got = near_dedup.near_duplicates(df).collect()
    assert Counter(r.doc_id for r in got) == Counter([*(i for i, _ in rows), None, None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got) and all(r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.near_duplicates(df.where("doc_id = 100").withColumn("bucket", F.lit(1)).withColumn("cls", F.lit(None))).count() == 2


def test_complete_groups_are_never_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "GATHER_ROWS", 7)
    keys = [k for k, n in enumerate((1, 30, 2, 2, 5, 1, 9)) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"bucket": keys[a : a + 4], "i": [0] * len(keys[a : a + 4])}) for a in range(0, len(keys), 4)]
    found = [t.column("bucket").to_pylist()[a:b] for t, at in near_dedup.complete_groups(iter(batches), ("bucket", "i")) for a, b in zip(at, at[1:], strict=False)]
    assert found == [[k] * keys.count(k) for k in range(7)]


def test_bit_estimate_is_close():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:857], rng.integers(0, 1 << 63, 143, dtype=np.uint64)])
    low = [near_dedup.minima(x) for x in (base, other)]
    equal = int(((low[0] & 15) == (low[1] & 15)).sum())
    differ = near_dedup.pack(low[0]).view("<u8") ^ near_dedup.pack(low[1]).view("<u8")
    folded = np.bitwise_or.reduce(differ.reshape(4, -1), axis=0)
    assert near_dedup.HASHES - int(np.bitwise_count(folded).sum()) == equal
    assert equal >= near_dedup.least_matches(75)


def test_language_id(docs, every, empty, spark):
    from pyspark.sql import functions as F

    fr, en = "le chat est sur la table avec une pomme et des amis", "the cat is on the table with an apple and some friends"
    rows = [(i, (fr if i % 2 else en) + f" {i}", "fr" if i % 2 else "en", None, None, None, None, None) for i in range(60)]
    train = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(train, F.col("doc_id") < 40)
    got = rows_of(language_id.identify(train, model))
    assert all(got[i].lang_pred == ("fr" if i % 2 else "en") and 0 <= got[i].score <= 1 and not got[i].rejected for i in range(60))
    other = in_order(language_id.identify(docs, model))
    assert [(r.doc_id, r.lang_pred, pytest.approx(r.score), r.rejected) for r in other] == [(i, *p) for i, p in zip([i for i, _ in in_order_of_ids(every)], language_id.predict(model, [t for _, t in in_order_of_ids(every)]), strict=True)]
    assert [r.lang_pred for r in other[:3]] == ["und"] * 3 and other[0].rejected and other[0].score == 0
    assert language_id.filter_rejected(train, model).count() == 60
    assert language_id.identify(train, language_id.fit(empty, F.lit(True))).where("lang_pred = 'und' and score = 0").count() == 60
    odd = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок", None, None, None, None, None, None)], DOCS)
    assert language_id.identify(odd, model).first().rejected


def brute_vector(text, idf):
    """Features of a text by a dictionary of its n-grams."""
    import numpy as np

    chars = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    chars = re.sub("^ +", " ", chars)
    grams = Counter(chars[k : k + n] for n in (1, 2, 3) for k in range(max(0, len(chars) - n + 1)) if not (k == 0 and n == 1))
    counts = np.zeros(language_id.DIMS)
    for g, k in grams.items():
        code = 0
        for c in g:
            code = code << 21 | ord(c)
        h = (code + ((len(g) - 1) << 62 >> 1)) & (2**64 - 1)
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & (2**64 - 1)
        counts[(h ^ h >> 31) >> 51] += k
    v = np.log1p(counts) * idf
    return v / np.linalg.norm(v)


def test_language_id_against_brute_force(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    pool = ["été", "chat", "the", "Straße", "niño", "12", "x!y", "ÇA", "漢字", "ʼn", "a\n\nb", "🙂", "  "]
    texts = [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(60)]
    whole = [language_id.gram_counts(t) for t in texts]
    texts, whole = zip(*((t, c) for t, c in zip(texts, whole, strict=True) if c is not None), strict=True)
    rows = [("ab"[k % 2], k, c) for k, c in enumerate(whole[:40])]
    model = language_id.train(rows, clusters=3)
    for t, c in zip(texts, whole, strict=True):
        v = brute_vector(t, model.idf)
        assert np.allclose(language_id.vectors(c[None], model.idf)[0], v, atol=1e-6)
        cos = model.centroids @ v
        lang, score, rejected = language_id.predict(model, [t])[0]
        best = int(np.argmax(cos))
        assert score == pytest.approx(float(cos[best]), abs=1e-5) and (lang == model.languages[model.owner[best]] or abs(np.sort(cos)[-1] - np.sort(cos)[-2]) < 1e-5)
    long = "  ".join(texts) * 3
    want = language_id.gram_counts(long)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert (language_id.gram_counts(long) == want).all(), size
    assert language_id.gram_counts("12 !") is None and language_id.gram_counts("") is None


def test_language_id_rejects_foreign_and_random_text(spark):
    import base64

    from pyspark.sql import functions as F

    rng = random.Random(3)
    known = {
        "en": "the and of to in that it is was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split(),
        "fr": "le de un et être avoir que pour dans ce il qui ne sur se pas plus pouvoir par je avec tout faire son mettre autre on mais nous comme ou si leur dire devoir avant deux même prendre aussi celui donner bien où fois vous encore nouveau aller cela entre premier vouloir déjà grand mon me moins aucun lui temps très savoir falloir voir quelque sans raison notre dont non an monde jour monsieur demander alors après trouver personne rendre part".split(),
    }
    clean = [(i, " ".join(rng.choices(known[lang], k=rng.randint(2, 80))), lang) for i in range(3000) for lang in [("en", "fr")[i % 2]]]
    odd = [(3000, "zz", "en"), (3001, "zz", "fr")]  # must not set the limit
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)),
        base64.b64encode(rng.randbytes(300)).decode(),
    ]
    df = spark.createDataFrame([*clean, *odd, *((9000 + k, t, None) for k, t in enumerate(foreign))], "doc_id long, text string, lang string")
    model = language_id.fit(df, F.col("doc_id") % 5 != 4)
    got = rows_of(language_id.identify(df, model))
    assert all(got[9000 + k].rejected for k in range(len(foreign)))
    assert sum(got[i].rejected for i, _, _ in clean if i % 5 == 4) <= 6  # of 600
    assert {r.doc_id for r in language_id.filter_rejected(df, model).collect()} == {i for i in got if not got[i].rejected}


def test_pii_matches_the_grammars():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    rng, anchors = random.Random(2), pii.automaton()
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(["a@.", "1 -", "+1", "1.2", "25.", "@a.b", "( )", "é", "0", "İ"])) for _ in range(rng.randint(1, 30)))
        want = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if valid(k, m[0])]
        assert [s for s in pii.find_spans(text, anchors) if s[0] in pii.BASE] == want, text
    text = "see https://a.example/x?y=1, account no. 1234-5678-90"
    found = pii.find_spans(text, anchors)
    assert [text[a:b] for k, a, b in found if k in ("url", "account")] == ["https://a.example/x?y=1", "1234-5678-90"]


def test_pii_accounts():
    anchors = pii.automaton()

    def found(text):
        return [text[a:b] for k, a, b in pii.find_spans(text, anchors) if k == "account"]

    assert found("account number: 12345678.") == found("Account No. is 12345678") == ["12345678"]
    assert found("IBAN GB29 NWBK 6016 1331 9268 19 or iban: DE89370400440532013000, thanks") == ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000"]
    assert found("IBAN GB29 NWBK 6016 1331 9268 18") == found("accounts 12345678") == found("account 123") == found("account") == []
    assert found("passport AB1234567") == ["AB1234567"] and found("İ" * 50 + " ssn 123-45-6789") == ["123-45-6789"]


def test_pii_rows(docs, every, empty):
    anchors = pii.automaton()
    got = in_order(pii.find_personal_data(docs))
    for r, (i, t) in zip(got, in_order_of_ids(every), strict=True):
        spans = pii.find_spans(t or "", anchors)
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in pii.BASE)
        assert (r.doc_id, r.spans, r.base_sha256) == (i, pii.joined(spans), hashlib.sha256(base.encode()).hexdigest())
    assert pii.find_personal_data(empty).count() == 0


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


@pytest.mark.parametrize("shard_words, pass_bytes", [(25, 1 << 20), (1_000_000, 1 << 20), (60, 40)])
def test_decontaminate(spark, monkeypatch, docs, texts, empty, shard_words, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    long = words_of(texts[9])
    items = [(1, " ".join(long[30:52]).upper()), (2, " ".join(long[100:109])), (3, "one"), (4, None), (5, "!!"), (None, " ".join(long[31:45])), (1, "a b, c d"), (6, " ".join(long[200:230]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, shard_words=shard_words).collect()
    windows: dict = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    want = {}
    for i, t in [*enumerate(texts), (None, texts[5])]:
        w, hit, named = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[x]
        want[i] = len(w), len(hit), sorted(named)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in found) == Counter((i, n, h, tuple(x)) for i, (n, h, x) in [*want.items(), (7, want[7])])
    got = {r.doc_id: r for r in found}
    assert got[9].n_hit and got[3].n_hit and got[4].n_hit
    for r in found:
        own = words_of(texts[5 if r.doc_id is None else r.doc_id])
        assert {p.item for p in r.passages} == set(r.items) and sum(b - a for a, b in zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True)) == r.n_hit
        for p in r.passages:
            assert any(own[p["at"] : p["at"] + p["words"]] == words_of(t)[p["item_at"] :][: p["words"]] for i, t in items if p["item"] == ("null" if i is None else str(i)))
    if shard_words > 25:
        assert ("6", 0, 200, 30) in {(p["item"], p["item_at"], p["at"], p["words"]) for p in got[9].passages}
    kept = Counter(r.doc_id for r in decontaminate.filter_contaminated(docs, bench).collect())
    assert kept == Counter(i for i in [*want, 7] if not want[i][1])
    assert decontaminate.filter_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.filter_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_longest_matches_over_shards(spark, docs, texts):
    long = words_of(texts[9])
    items = [(1, " ".join([*long[30:52], "new", *long[500:503]])), (2, texts[5]), (None, "nowhere one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item, r.item_at): (r.words, r.doc_id, r["at"]) for r in decontaminate.longest_matches(docs, bench, shard_words=5000).collect()}
    every = [(i, words_of(t)) for i, t in enumerate(texts)]
    want = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w)):
            best = (0, None, None)
            for d, own in every:
                for at in range(len(own)):
                    n = 0
                    while k + n < len(w) and at + n < len(own) and w[k + n] == own[at + n]:
                        n += 1
                    if n > best[0]:
                        best = n, d, at
            want["null" if i is None else str(i), k] = best
    assert got == want and got["1", 0] == (22, 9, 30) and got["null", 0][0] == 0


def brute_fingerprint(samples):
    """The same by loops and a plain transform of each frame."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).astype(np.float32)
    x = x - x.mean()
    frames = max(1, math.ceil((len(x) - media.FRAME) / media.HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * media.HOP + media.FRAME - len(x), np.float32)])
    tops = []
    for f in range(frames):
        m = np.round(np.abs(np.fft.rfft(x[f * media.HOP :][: media.FRAME] * np.hanning(media.FRAME).astype(np.float32))), 3)
        peaks = [k for k in range(1, len(m) - 1) if m[k] > m[k - 1] and m[k] >= m[k + 1] and m[k] > 1]
        tops.append(sorted(peaks, key=lambda k: (-m[k], k))[: media.PEAKS])
    pairs = []
    for f, own in enumerate(tops):
        pairs += [(f, own[a] << 12 | own[b] << 4) for a in range(len(own)) for b in range(a + 1, len(own))]
        later = [(ahead, p, b) for ahead in range(1, media.AHEAD + 1) if f + ahead < frames for p, b in enumerate(tops[f + ahead])]
        chosen = sorted((ahead, p, a, own[a] << 12 | b << 4 | ahead) for a in range(len(own)) for ahead, p, b in later[: media.FAN])
        pairs += [(f, code) for _, _, _, code in chosen]
    return pairs


def test_media(docs, every, empty):
    got = in_order(media.media_columns(docs))
    by_text = {}
    for r, (i, t) in zip(got, in_order_of_ids(every), strict=True):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        with wave.open(__import__("io").BytesIO(bytes(r.media))) as f:
            assert (f.getsampwidth(), f.readframes(f.getnframes())) == (1, payload)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(bytes(r.media)) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert by_text.setdefault(t or "", (r.fp_times, r.fp_codes)) == (r.fp_times, r.fp_codes)
        if raw:
            assert list(zip(r.fp_times, r.fp_codes, strict=True)) == brute_fingerprint(payload), i
    assert by_text[""] == ([], []) and max(len(t) for t in by_text) > media.SLICE * media.HOP
    assert media.media_columns(empty).count() == 0


@pytest.mark.parametrize("samples", [bytes([128] * 100 + [7] + [128] * 900 + [250] * 3 + [128] * 3000 + list(range(200)) + [128] * 90), b"a" * 4000 + b"b" + b"a" * 4000, bytes(range(256)) * 30])
def test_sparse_peaks_find_partners_further_on(samples):
    times, codes = media.fingerprint(samples)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == brute_fingerprint(samples)


def test_a_tone_has_one_peak():
    import numpy as np

    tone = (128 + 100 * np.sin(2 * np.pi * 32 * np.arange(4096) / media.FRAME)).astype(np.uint8).tobytes()
    _, codes = media.fingerprint(tone)
    assert len(codes) and all(c >> 12 == 32 for c in codes[:1])


def test_hilbert_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    for dims, bits in ((2, 3), (3, 2), (2, 1)):
        axes = [F.expr(f"cast(id div {1 << bits * k} % {1 << bits} as int)") for k in range(dims)]
        rows = spark.range(1 << dims * bits).select(*[a.alias(f"a{k}") for k, a in enumerate(axes)], hilbert_shards.curve_index(axes, bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(rows)))
        assert all(sum(abs(x - y) for x, y in zip(a[:dims], b[:dims], strict=True)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def hilbert_cells(dims, bits):
    """Cells in the order of the curve, by walking Skilling's transform cell by cell."""
    def index(axes):
        x, n, q = list(axes), dims, 1 << (bits - 1)
        while q > 1:
            p = q - 1
            for i in range(n):
                if x[i] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[i]) & p
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, n):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[n - 1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))

    return index


def test_hilbert_shards(docs, every, empty):
    got = hilbert_shards.hilbert_shards(docs, shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in every)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    keys = [(r.hilbert, r.doc_id is not None, r.doc_id, r.text_crc32, r.size) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys)  # nulls first
    assert hilbert_shards.hilbert_shards(empty).count() == 0


def test_cells_hold_equal_shares_of_the_rows_and_order_them(spark):
    from bisect import bisect_right

    rng = random.Random(6)
    rows = [(k, "hot" if k % 3 == 0 else f"s{rng.randint(0, 99):02d}", rng.choice(["a", "b", None]), rng.randint(0, 1000) if k % 50 else None, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    limits = hilbert_shards.quantiser(df, ["source", "lang", "n_chars"], 2)
    assert limits["lang"] == ["b"] and all(v == sorted(v) and len(v) <= 3 for v in limits.values())
    cell = lambda d, v: 0 if v is None else bisect_right(limits[d], v)
    shares = Counter(cell("source", r[1]) for r in rows)
    assert shares[cell("source", "hot")] < 1700 and len(shares) > 2  # the hot value's cell takes little besides it
    assert max(Counter(cell("n_chars", r[3]) for r in rows).values()) < 900
    index = hilbert_cells(3, 2)
    got = rows_of(hilbert_shards.hilbert_shards(df, bits=2))
    assert all(got[r[0]].hilbert == index([cell("source", r[1]), cell("lang", r[2]), cell("n_chars", r[3])]) for r in rows)


def test_write_shards_keeps_every_row(spark, docs, every, tmp_path):
    from pyspark.sql import functions as F

    named = docs.withColumn("shard", F.lit("own")).withColumn("hilbert", F.lit(None).cast("string"))
    column = hilbert_shards.write_shards(named, f"{tmp_path}/shards", shards=7)
    assert column == "shard_"
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert set(back.columns) == {*named.columns, column}
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == Counter((i, t, "own") for i, t in every)
    placed = Counter((r.doc_id, r.shard) for r in hilbert_shards.hilbert_shards(named, shards=7).collect())
    assert Counter((r.doc_id, r[column]) for r in back.collect()) == placed


def test_lm_score(docs, texts, every, empty):
    import numpy as np
    from pyspark.sql import functions as F

    learn, held = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(False)), F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    tokens = [re.findall("[^\x20\x09-\x0d]+", lower(t)) + ["\n"] for t in texts]
    counts = Counter(w for i, own in enumerate(tokens) if i % 4 for w in own)
    counts.update(tokens[7])  # its second row
    total = sum(counts.values())
    names = {w: k for k, w in enumerate(sorted(counts))}
    learnt = [own for i, own in enumerate(tokens) if i % 4] + [tokens[7]]
    grams = [{g: n for g, n in Counter(tuple(names[w] for w in own[k : k + size]) for own in learnt for k in range(len(own) - size + 1)).items() if n >= 2} for size in (2, 3)]
    auto = lm_score.Automaton({w.encode(): k for w, k in names.items()}, np.array([counts[w] for w in names]), grams, total, len(names))
    got = in_order(lm_score.score_documents(docs, learn, held))
    for r, (i, _) in zip(got, in_order_of_ids(every), strict=True):
        own = tokens[5 if i is None else i]
        plain = [math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own]
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (i, len(own), sum(counts[w] > 0 for w in own), total, i is not None and i % 4 == 0)
        assert r.base_score == pytest.approx(sum(plain)) and r.score == pytest.approx(auto.score([names.get(w, -1) for w in own], plain)), i
    assert lm_score.score_documents(empty, learn, held).count() == 0
    nothing = lm_score.score_documents(docs, learn & F.lit(False), held).first()
    assert nothing.train_tokens == nothing.n_known == 0 and nothing.score == pytest.approx(0)


def test_lm_score_keeps_every_repeated_n_gram(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(8)
    pool, odds = [f"w{k}" for k in range(4000)], [1 / (k + 1) for k in range(4000)]
    tokens = [[*rng.choices(pool, odds, k=300), "\n"] for _ in range(120)] + [["rare", "pair", "here", "\n"]] * 3
    learnt = [own for i, own in enumerate(tokens) if i % 4 and i < 122]
    counts = Counter(w for own in learnt for w in own)
    names, total = {w: k for k, w in enumerate(sorted(counts))}, sum(counts.values())
    grams = [{g: n for g, n in Counter(tuple(names[w] for w in own[k : k + size]) for own in learnt for k in range(len(own) - size + 1)).items() if n >= 2} for size in (2, 3)]
    assert total > 20_000 and counts["rare"] == 1 and sum(n == 2 for n in counts.values()) > 100
    auto = lm_score.Automaton({w.encode(): k for w, k in names.items()}, np.array([counts[w] for w in names]), grams, total, len(names))
    df = spark.createDataFrame([(i, " ".join(own[:-1])) for i, own in enumerate(tokens)], "doc_id long, text string").repartition(3)
    learn = (F.col("doc_id") % 4 != 0) & (F.col("doc_id") < 122)
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 5000, raising=False)
    got = {r.doc_id: r.score for r in lm_score.score_documents(df, learn, ~learn).collect()}
    for i, own in enumerate(tokens):
        plain = [math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own]
        assert got[i] == pytest.approx(auto.score([names.get(w, -1) for w in own], plain)), i


def test_automaton_states_sum_to_one():
    import numpy as np

    grams = [{(0, 1): 5, (1, 0): 4, (1, 2): 3}, {(0, 1, 2): 3, (1, 0, 1): 2}]
    auto = lm_score.Automaton({b"a": 0, b"b": 1, b"c": 2}, np.array([9, 8, 6]), grams, 25, 4)
    plain = [math.log10((c + 0.1) / (25 + 0.1 * 5)) for c in (9, 8, 6)]
    rest = 1 - sum(10**p for p in plain)  # words that no state reads
    for before in ([], [0], [1], [0, 1], [1, 0], [2]):
        each = [auto.score([*before, v], [plain[k] for k in [*before, v]]) - auto.score(before, [plain[k] for k in before]) for v in range(3)]
        other = auto.score([*before, -1], [*(plain[k] for k in before), math.log10(rest)]) - auto.score(before, [plain[k] for k in before])
        assert sum(10**x for x in [*each, other]) == pytest.approx(1)


def test_bpe_equals_the_library(docs, every, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = in_order(bpe.encode_bpe(docs, bpe.default_tokenizer()))
    for r, (i, t) in zip(got, in_order_of_ids(every), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, bytes(r.token_ids), r.n_tokens) == (i, b"".join(x.to_bytes(4, "little") for x in want), len(want))
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_bpe(empty, bpe.default_tokenizer()).count() == 0


def test_bpe_of_every_code_point():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        own = bpe.BacktrackingBPE(f.read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    for at in range(0, len(points), 10_000):
        some = points[at : at + 10_000]
        for c, want in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
            assert own.encode(c)[0] == b"".join(x.to_bytes(4, "little") for x in want.ids), hex(ord(c))


def test_bpe_on_odd_strings():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        own = bpe.BacktrackingBPE(f.read())
    rng = random.Random(4)
    pools = ["abcdefghij", "thein gros", "\x1c\x85  ab", "éÉßİΣσςñ", "漢字かな🙂👍🏽", "0123½Ⅷ٣", "'s't've'll!?.,<|>", "\x00\x01́e", "aAbB\n\r\t ", "ﬁǅʰªº"]
    for n in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 60))) + ("<|endoftext|>x" if n % 9 == 0 else "")
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == (b"".join(x.to_bytes(4, "little") for x in want), library.decode(want, skip_special_tokens=False)), text
    text = "ab" * 20_000
    assert len(own.encode(text)[0]) == 4 * len(library.encode(text, add_special_tokens=False).ids)


def test_warc_revisits(spark):
    schema = "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload_digest string, extra string"
    full = lambda i, url, ts, tag, date=None: (i, url, ts, "response", 200, tag, date, {"ETag": tag, "etag": tag, "Content-Length": "9"}, f"d{i}", None)
    again = lambda i, url, ts, tag, date=None: (i, url, ts, "revisit", 304, tag, date, {"Date": "now", "Content-Length": "0"}, None, None)
    day = 86_400
    rows = [
        full(1, "http://www.a.example/x/?utm_source=q&b=2&a=1#f", 10, '"t"'), full(2, "https://a.example/x?a=1&b=2", 20, '"u"'), full(3, "https://A.example:443/x?b=2&a=1", 20, '"v"'),
        again(4, "a.example/x?a=1&b=2", 15, 'W/"t"'), again(5, "a.example/x?a=1&b=2", 20, '"t"'), again(6, "a.example/x?a=1&b=2", 9 * day, '"v"'), again(7, "a.example/x?a=1&b=2", 9 * day, '"u"'),
        again(8, "a.example/x?a=1&b=2", 10, '"t"'), again(9, "b.example", 10, '"t"'), again(10, None, 10, '"t"'), again(11, "a.example/x?a=1&b=2", None, '"t"'), again(12, "a.example/x?a=1&b=2", 30, None), again(6, "a.example/x?a=1&b=2", 9 * day, '"v"'),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {i: got[i].outcome for i in range(4, 13)} == {4: "resolved", 5: "resolved", 6: "resolved", 7: "mismatch", 8: "orphan", 9: "orphan", 10: "orphan", 11: "orphan", 12: "unverified"}
    assert (got[4].source_id, got[5].source_id, got[6].source_id) == (1, 1, 3) and got[6].payload_digest == "d3" and got[6].status == 200
    assert got[6].headers == {"etag": '"v"', "content-length": "9", "date": "now"}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(12)
    pools = {"en": "the and of to in that it was for on are with as his they be at one have this from".split(), "fr": "le de un et être avoir que pour dans ce il qui ne sur se pas plus pouvoir par je".split()}
    line = lambda lang, n: " ".join(rng.choices(pools[lang], k=n))
    shared = {lang: line(lang, 14) for lang in pools}
    passage = line("en", 12)
    rows = []
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        lines = [line(lang, rng.randint(5, 30)) for _ in range(rng.randint(1, 5))] + [shared[lang].upper()] * (i % 3 == 0) + [passage] * (i % 40 == 4)
        rows.append((i, "\n".join(lines), lang))
    for i in range(160, 190):  # loose copies
        words = rows[i % 4][1].split(" ")
        rows.append((i, " ".join(w if rng.random() > 0.004 * (i - 160) else "avoir" for w in words), rows[i % 4][2]))
    rows += [(190, None, "en"), (191, "", "fr"), (192, "12 34", "en"), (193, line("en", 40_000), "en"), (None, rows[3][1], "fr"), rows[5], rows[5], (194, "Съешь же ещё этих мягких французских булок", None)]
    schema = S.StructType([*DOCS.fields[:5], S.StructField("_drops", S.StringType()), S.StructField("_gone", S.LongType())])
    df = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "own", 7) for i, t, lang in rows], schema)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False)))
    left = [(i, t) for (i, t, _), (_, _, gone) in zip(rows, language_id.predict(model, [t for _, t, _ in rows]), strict=True) if not gone]
    assert 150 < len(left) < len(rows) - 3

    where: dict = {}
    for i, t in left:
        for x in t.split("\n"):
            if i is not None and len(x.strip()) >= 40:
                where.setdefault(lower(x.strip()), set()).add(i)
    keeper = {k: max(v) for k, v in where.items() if len(v) >= 5}
    assert keeper
    left = [(i, "\n".join(x for x in t.split("\n") if keeper.get(lower(x.strip()), i) == i)) for i, t in left]
    known = [(i, t) for i, t in left if i is not None]
    group = groups_of([i for i, _ in known], shingle_sets([t for _, t in known]))
    assert sum(group[i] != i for i in group) > 5
    left = [(i, t) for i, t in left if i is None or group[i] == i]
    gram = lambda t: {tuple(w[k : k + 10]) for w in [words_of(t)] for k in range(len(w) - 9)}
    clean = [(i, t) for i, t in left if not gram(t) & gram(passage)]
    assert len(clean) < len(left)

    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    stage = docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, stage, str(tmp_path))
        assert out.columns == docs.columns or name == "bpe", name
        out.write.parquet(f"{tmp_path}/{name}")
        last, stage = stage, spark.read.parquet(f"{tmp_path}/{name}")
    assert Counter(tuple(r) for r in stage.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    assert {(r._gone, r._drops) for r in last.select("_gone", "_drops").collect()} == {(7, "own")}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages_keep_the_schema(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    plain = S.StructType(DOCS.fields[:5])
    body = "the cat is on the table with an apple and some friends who like to read long books "
    rows = [(i, body * 2 + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(30)] + [(30, "1 2 3", "en", "s", 1), (31, body * 2 + " ".join(f"w0x{k}" for k in range(30)), "en", "s", 1), (32, body + "the quick brown fox jumps over the lazy dog near a river bank", "en", "s", 1)]
    spark.createDataFrame(rows, plain).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near a river")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "bpe" or docs.columns == plain.names
    assert 30 not in seen["language_id"] and 31 not in seen["near_dedup"] and 0 in seen["near_dedup"] and 32 not in seen["decontaminate"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["bpe"] == set(range(30))


def test_steps_hold_slices_of_a_batch(monkeypatch):
    """However large an Arrow batch, contamination is searched in, and decoded text made of, at most 1,024 rows at once."""
    sizes, shards = [], decontaminate._shards
    monkeypatch.setattr(decontaminate, "_shards", lambda texts, limit: sizes.append(len(texts)) or shards(texts, limit))
    block = SimpleNamespace(value=decontaminate.make_blocks([("a", b" ".join(b"w%d" % n for n in range(12)))], 10)[0])
    texts = [" ".join(f"w{n}" for n in range(12)) if k % 1000 == 0 else f"other {k}" for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500), pa.int64()), pa.array(texts)], ["_id", "_text"])
    out = [r for b in decontaminate._scan([block], 1_000_000)(iter([batch])) for r in b.to_pylist()]
    assert [r["_id"] for r in out] == list(range(2500)) and [r["_id"] for r in out if r["n_hit"]] == [0, 1000, 2000]
    assert sizes == [1024, 1024, 452]


def test_stages_bound_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        bound_batches(spark)
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "1m")  # a session's own bound stays
        bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
