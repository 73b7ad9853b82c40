"""Each operator against a plain version of itself, on small tables and awkward rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from compare import same_rows
from pyspark.sql import functions as F

from lodestone.llm import bwt, chat, exact_dedup, langid, mixing, packing, quality, secrets, simhash, topk, toxicity
from lodestone.llm.common import tokenizer_path
from lodestone.llm.hash_sql import xxh64
from lodestone.llm.queries import ORACLES, QUERIES

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, word string, rate double"
ROWS = [
    (1, LONG, "en", "a", 5, "x", "w", 1.0), (2, LONG + "more", "en", "a", 5, "x", "w", None), (3, None, "en", None, None, None, None, None),
    (4, "", "de", "a", 0, "x", "w", 1.0), (5, "  \n\t ", "de", "a", 0, "x", "w", 1.0), (6, "word", None, "a", 4, "x", "w", 1.0),
    (7, "long " * 20_000, "fr", "b", 100_000, "x", "w", 1.0), (1, LONG, "en", "a", 5, "x", "w", 1.0), (None, "nobody's text", "en", "a", 1, "x", "w", 1.0),
    (8, "l'été à Évian\npassword = 'hunter22x'", "fr", "b", 10, "x", "w", 1.0), (9, "word", "en", "a", 4, "x", "w", 1.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same_rows(spark, sf, QUERIES[name], ORACLES[name])


def test_hash_in_sql():
    r = np.random.default_rng(3)
    texts = [(n, r.bytes(n)) for n in (0, 1, 3, 4, 5, 7, 8, 9, 12, 15, 16, 31, 32, 33, 36, 40, 63, 64, 65, 127, 200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, h VARCHAR, seed UHUGEINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(n, b.hex(), 42 + n) for n, b in texts])
    got = dict(con.execute(f"WITH RECURSIVE {xxh64('t', 'o')} SELECT k, x FROM o").fetchall())
    assert got == {n: xxhash.xxh64_intdigest(b, seed=42 + n) for n, b in texts}


def test_every_operator_takes_awkward_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    talks = spark.createDataFrame([(0, None, None, None), (None, 1, "user", "x"), (3, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert quality.judge(docs, labels.select("doc_id")).count() == n
        assert secrets.scan(docs).count() == n and secrets.mask_secrets(docs).columns == docs.columns
        model = toxicity.fit(docs, labels)
        assert toxicity.score(docs, model).where("score BETWEEN 0 AND 1").count() == n
        assert toxicity.remove_toxic(docs, model).columns == docs.columns
        assert langid.identify(docs, langid.collect_samples(docs)).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert simhash.keep_representatives(docs).columns == docs.columns
        assert exact_dedup.remove_repeats(docs).count() == n
        assert mixing.mix(docs, docs.select("text", F.col("lang").alias("domain")), mixing.TARGETS).count() >= n
        assert packing.pack_documents(docs, tokenizer_path()).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    out = chat.format_preferences(chat.swapped_replies(talks)).orderBy("pair_id").collect()
    assert [(r["pair_id"], r["chosen_id"], r["rejected_id"]) for r in out] == [(0, 0, None), (1, None, 3)]
    assert chat.format_preferences(chat.swapped_replies(talks.limit(0))).count() == 0
    pairs = spark.createDataFrame([(7, 0, 99), (8, None, 3)], "pair_id long, chosen long, rejected long")
    out = chat.format_preferences(chat.pair_turns(talks, pairs)).orderBy("pair_id").collect()
    assert [(r["n_prompt_turns"], r["chosen"], r["rejected_mask"]) for r in out] == [(0, "<||>\n\n<|end|>\n", ""), (0, "", "14:23")]


def test_quality_counts(spark, sf, real):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = rows(QUERIES["op1_quality_rules"](spark, sf))
    for doc_id, text in real:
        w, seen = word.findall(text), {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        covered = {k for v in seen.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if word.search(x)]
        r = got[doc_id]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_ratio_against_plain_counts(spark):
    rng = np.random.default_rng(19)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(40 if i % 2 else 20)], int(rng.integers(0, 90))))) for i in range(60)] + [(60, None), (61, " \n"), (62, "one")]
    good = {i for i in range(0, 60, 3)} | {62, 999}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(quality.judge(df, spark.createDataFrame([(i,) for i in good] + [(0,), (None,)], "doc_id long")))
    grams = {i: [(w,) for w in (t or "").split()] + list(zip((t or "").split(), (t or "").split()[1:], strict=False)) for i, t in docs}
    every = sorted({g for v in grams.values() for g in v})
    frame = spark.createDataFrame([(k, *g, *[None] * (2 - len(g))) for k, g in enumerate(every)], "k int, a string, b string")
    bucket = F.pmod(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64(F.lit(2), "a", "b")), F.lit(quality.BUCKETS))
    at = {every[r["k"]]: r["x"] for r in frame.select("k", bucket.alias("x")).collect()}
    raw, trusted = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, v in grams.items():
        for g in v:
            raw[at[g]] += 1
            trusted[at[g]] += i in good
    weight = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    for i, v in grams.items():
        want = np.mean([weight[at[g]] for g in v]) if v else None
        assert got[i]["log_ratio"] == (None if want is None else pytest.approx(want, abs=1e-9))
        assert got[i]["kept"] == (not got[i]["base_failed"] and want is not None and want >= quality.THRESHOLD)


def test_quality_verdict(spark, sf):
    got = QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.2 * bad.count()


def plain_preference(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = [n, "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in chosen[:n])]
    for side in (chosen[n:], rejected[n:]):
        text, mask = "", []
        for role, t in side:
            text += f"<|{role}|>\n"
            a = len(text)
            text += f"{t}\n<|end|>\n"
            mask += [f"{a}:{len(text)}"] * (role == "assistant")
        out += [text, ",".join(mask)]
    return tuple(out)


def test_preferences_against_the_plain_form(spark):
    rng = np.random.default_rng(16)
    turn = lambda: (str(rng.choice(["user", "assistant", "system", ""])), "é\U0001f600" * int(rng.integers(0, 3)) + str(rng.integers(0, 3)))
    sides = []
    for i in range(60):
        shared = [turn() for _ in range(int(rng.integers(0, 5)))]
        a, b = (shared + [turn() for _ in range(int(rng.integers(0, 3)))] for _ in range(2))
        sides.append((i, a, shared if i % 10 == 0 else a if i % 10 == 1 else b))
    sides += [(100, [("user", "x" * 200_000), ("assistant", "y")], [("user", "x" * 200_000), ("assistant", "z")]), (101, [], []), (102, [("user", "a"), ("assistant", "b"), ("user", "a")], [("user", "a"), ("user", "a"), ("assistant", "b")])]
    rows = [(2 * i + s, k, r, t) for i, *both in sides for s, side in enumerate(both) for k, (r, t) in enumerate(side)]
    talks = spark.createDataFrame(rows + rows[:40], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i, *_ in sides], "pair_id long, chosen long, rejected long")
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.pair_turns(talks, pairs)).collect()}
    for i, a, b in sides:
        r = got[i]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["chosen_mask"], r["rejected"], r["rejected_mask"]) == plain_preference(a, b)
    assert {got[i]["n_prompt_turns"] for i, *_ in sides} >= {0, 1, 2, 3}


def test_swapped_replies(spark, sf):
    u, a = (lambda t: ("user", t)), (lambda t: ("assistant", t))
    talks = {0: [u("q"), a("r"), u("q2"), a("r2"), u("bye")], 1: [u("z"), a("s")], 2: [u("q"), a("r")], 3: [u("z")], 4: [u("q")], 5: [u("q"), a("r")], 7: [a("r")], 8: [u("q"), a("r")], 10: [u("q"), a("r")], 11: [a("n"), a("r")]}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    want = {0: (talks[0], talks[0][:3] + [a("s")]), 1: (talks[2], [u("q")]), 2: (talks[4], talks[5]), 3: ([], talks[7]), 4: (talks[8], [u("q")]), 5: (talks[10], talks[10])}
    got = {r["pair_id"]: tuple([tuple(y) for y in r[c]] for c in ("chosen", "rejected")) for r in chat.swapped_replies(df).collect()}
    assert got == want
    found = QUERIES["op5_chat_formatting"](spark, sf)
    assert 2 * found.where("n_prompt_turns > 0").count() > found.count()
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_secrets():
    text = 'cfg = {"db_password": "hunter2hunter2"}\nX = "s3cr3tV4lue99"\nclient_secret = X\nAPI-key: zzz token=abcde password : token=abcdefg'
    kinds = {(k, text[a:b]) for a, b, k in secrets.spans(text)}
    assert ("lexed", "s3cr3tV4lue99") in kinds and ("assign", "password : token=abcdefg") in kinds
    assert not any(k == "assign" and v == "token=abcde" for k, v in kinds)
    assert secrets.base_spans("AKIA" + "A" * 16) == [(0, 20, "access")] and not secrets.base_spans("AKIA" + "A" * 15)
    assert secrets.base_spans("é" + "a" * 24) == [(1, 25, "hex")]
    assert secrets.base_spans("toKen=abcdefgh") == []
    assert "hunter2" not in secrets.redact(text) and secrets.redact("plain = text") == "plain = text"
    assert secrets.spans(None) == [] and secrets.redact(None) is None


def test_secret_chains_take_no_more_than_their_length():
    chain = "".join(f"k{i % 7}:v{i}=" for i in range(60_000))
    assert secrets.lexed_spans(chain + "; db_password = zq81kk0vvTx") == [(len(chain) + 16, len(chain) + 27, "lexed")]
    assert {(a, b) for a, b, k in secrets.lexed_spans("db_pwd=auth=q7Rt99xWv2")} == {(7, 22)}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("DB_PWD=/q8Zt5Rw2Lk9Vx3Nm", "/q8Zt5Rw2Lk9Vx3Nm"), ("AWS_SECRET_ACCESS_KEY=/wJalrXUtnFEMI7K", "/wJalrXUtnFEMI7K"), ("db_pwd: /q8Zt5Rw2Lk9Vx3Nm", "/q8Zt5Rw2Lk9Vx3Nm"),
        *[(f'SIGNING_KEY = {p}"q8Zt5Rw2Lk9Vx3Nm"', "q8Zt5Rw2Lk9Vx3Nm") for p in ("b", "r", "f", "Rb", "@", "$@", "r#", '""')],
        ("const dbPwd = `q8Zt5Rw2Lk9Vx3Nm`;", "q8Zt5Rw2Lk9Vx3Nm"), ('val dbPwd: String = "q8Zt5Rw2Lk9Vx3Nm"', "q8Zt5Rw2Lk9Vx3Nm"),
        ('signing_key: Optional[Dict[str, List[str]]] = "q8Zt5Rw2Lk9Vx3Nm"', "q8Zt5Rw2Lk9Vx3Nm"), ("dbPwd?: string | null = 'q8Zt5Rw2Lk9Vx3Nm'", "q8Zt5Rw2Lk9Vx3Nm"),
        ("const DB_PWD: &'static str = \"q8Zt5Rw2Lk9Vx3Nm\";", "q8Zt5Rw2Lk9Vx3Nm"), ('var dbPwd string = "q8Zt5Rw2Lk9Vx3Nm"', "q8Zt5Rw2Lk9Vx3Nm"),
    ],
)
def test_secrets_of_common_assignments(text, value):
    assert [text[a:b] for a, b, k in secrets.lexed_spans(text)] == [value]
    assert value not in secrets.redact(text)


def test_secret_lexer_takes_no_addresses_and_types():
    for text in ("auth_token://host9/Path8Xy2", "password: str = None", "db_pwd: String\nlabel = 'q8Zt5Rw2Lk9Vx3Nm'", "db_pwd: see; label = 'q8Zt5Rw2Lk9Vx3Nm'"):
        assert secrets.lexed_spans(text) == []


def test_secret_scan_digest(spark, sf, real):
    got = rows(QUERIES["op2_secret_scans"](spark, sf))
    patterns = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"access": 20, "hex": 24}
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for doc_id, text in real:
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m.group(2)) >= 6]
        found += [(m.start(), 1 + (k == "hex"), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if len(m.group()) >= least[k]]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        assert got[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    data, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        data.append(sorted(map(int, [1] * int(a) + [2] * int(b) + list(rng.choice(np.arange(10, 40), 5, replace=False)))))
        y.append(int(a and b))
    m = toxicity.train(data, y, epochs=25)
    p = [m.logit(np.array([m.rows[i] for i in r if i in m.rows], int)) > 0 for r in data]
    assert np.mean(np.array(p) == np.array(y)) > 0.97


def test_toxicity_against_all_pairs(spark):
    rng = np.random.default_rng(18)
    words = ["vile", "slur", "group", "kind", "Word", "\u00e9t\u00e9", "x1y", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12))).tolist())) for i in range(200)] + [(200, None), (201, ""), (202, "vile " * 5000)]
    labels = [(i, int("vile" in t and "group" in t)) for i, t in docs[:200]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # without the penalty that clears factors of so few rows
    model = toxicity.train([np.array(toxicity.buckets(t), "<i4") for _, t in docs[:200]], [y for _, y in labels], l1_pairs=0.0)
    assert len(model.rows) > 5 and np.abs(model.v).max() > 0.01
    got = rows(toxicity.score(df, model))
    for i, text in docs:
        # a term: a run of letters and of whatever isn't ASCII
        terms = {t.encode() for t in re.findall(r"[a-z\u0080-\U0010ffff]+", (text or "").lower())}
        at = sorted({model.rows[b] for b in {zlib.crc32(t) % (1 << toxicity.BITS) for t in terms} if b in model.rows})
        z = model.bias + sum(model.w[a] for a in at) + sum(model.v[a] @ model.v[b] for k, a in enumerate(at) for b in at[:k])
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_held_out(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    got = QUERIES["op3_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = got.where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.88
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got.collect())


def test_toxicity_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 3, "vile slur" if i % 3 == 0 else "kind word") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (0, 0)], "doc_id long, toxic int")
    once, often = (toxicity.fit(d, labels) for d in (docs.distinct(), docs))
    assert once.bias == often.bias and once.rows == often.rows


def test_language_samples_come_from_whole_texts(spark):
    late = "x" * 9_000 + "y" * 9_000
    docs = spark.createDataFrame([(1, late, "a"), (1, late, "a"), (2, "zz", "a"), (3, None, "a"), (4, "", "b"), (None, "q", "b")], "doc_id long, text string, lang string")
    got = langid.collect_samples(docs)
    assert list(got) == ["a"] and sorted(got["a"].replace("\n", "")) == sorted(late + "zz")


def plain_phrases(symbols, known):
    """Phrases of a greedy parse; a symbol that ``known`` lacks opens one that the longest match after it joins."""
    n = i = 0
    while i < len(symbols):
        j = i + (symbols[i : i + 1] not in known)
        k = j
        while k < len(symbols) and symbols[j : k + 1] in known:
            k += 1
        n, i = n + 1, max(k, i + 1)
    return n


@pytest.mark.parametrize("block", [3, 16, 2048])
def test_language_parse_against_the_plain_one(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(14)
    samples = {"x": "abracadabra alakazam", "y": "hocus pocus fidibus", "z": "".join(rng.choice(list("ab "), 300)), "\u4e2d": "".join(chr(0x4E00 + i % 331) for i in range(0, 4000, 7)) + "\u03b1\u03b2\u03b3"}
    parser = langid.Parser(samples)
    texts = ["abra kadabra fidi", "zzz", "a", "pocus" * 1000, "".join(rng.choice(list("ab "), 500)), "a" * 40, "\u4e00\u4e07\u4e0e q \u03b1", "", None, "12", "\U00010400bus"]
    counts, sizes = parser.phrases(texts)
    for i, text in enumerate(texts):
        symbols = bytes(parser.alphabet.symbols(text or ""))
        assert sizes[i] == len(symbols)
        for k, lang in enumerate(parser.languages):
            assert counts[i, k] == plain_phrases(symbols, bytes(parser.alphabet.symbols(samples[lang])))
    assert parser.predict([None, "123", "abracadabra"])[:2] == [("und", 0.0)] * 2


def test_language_alphabet_keeps_letters_apart():
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x450), *range(0x4E00, 0x4F00))]
    alphabet = langid.Alphabet(["".join(letters)])
    codes = {bytes(alphabet.symbols(c)) for c in letters}
    assert len({bytes(alphabet.symbols(c)) for c in letters}) == len({c.lower() for c in letters}) and alphabet.width <= langid.WIDTH
    assert bytes(alphabet.symbols("\u0905")) not in codes and len(alphabet.symbols("12 !")) == 0
    assert langid.Alphabet(["abc \u00e9"]).symbols("A1b").tolist() == langid.Alphabet(["abc \u00e9"]).symbols("a b").tolist()


def test_many_languages_share_the_sample(spark):
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 20) * 30} {chr(98 + i % 5) * 3000}", f"l{i % 40}") for i in range(200)] + [(500 + i, "same text again", "rep") for i in range(3000)], "doc_id long, text string, lang string")
    got = langid.collect_samples(docs)
    assert len(got) == 41 and got["rep"] == "same text again" and max(map(len, got.values())) <= 2 * langid.SAMPLES // 41 + langid.PASSAGE


def test_language_held_out(spark, sf):
    got = QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95


def plain_best(v, ids, q, k=20):
    """(id, score) of the k best ids of row q of v, one score an id."""
    best = {}
    for i, s in zip(ids, v.astype(object) @ v[q].astype(object), strict=True):
        if i != ids[q]:
            best[int(i)] = max(best.get(int(i), s), s)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def of_query(found, i):
    q, ids, scores = found
    return [(int(a), int(b)) for a, b in zip(ids[q == i], scores[q == i], strict=True)]


def test_m_tree_with_ties():
    rng = np.random.default_rng(1)
    v = rng.integers(-20, 20, (400, 6))
    v[100:300] = v[0]
    tree = topk.MTree(np.arange(400), v, page=8)
    some = np.arange(0, 400, 17)
    found = tree.search(v[some], some, 20)
    for i, q in enumerate(some):
        assert of_query(found, i) == plain_best(v, np.arange(400), q)


def test_m_tree_takes_a_bound_from_elsewhere():
    rng = np.random.default_rng(2)
    v = rng.integers(-20, 20, (500, 5))
    tree = topk.MTree(np.arange(500), v, page=16)
    want = [plain_best(v, np.arange(500), q) for q in range(30)]
    limits = np.array([w[7][1] for w in want], float)
    found = tree.search(v[:30], np.arange(30), 20, limits)
    for i, w in enumerate(want):
        assert [x for x in of_query(found, i) if x[1] >= limits[i]] == [x for x in w if x[1] >= limits[i]]


def test_m_tree_scores_few_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    v = np.floor(64 * (np.repeat(centres, 100, axis=0) + rng.normal(0, 0.02, (4000, 16))))
    v = np.floor(64 * 10 * v / np.linalg.norm(v, axis=1)[:, None])
    tree = topk.MTree(np.arange(4000), v, page=64)
    some = np.arange(0, 4000, 50)
    found = tree.search(v[some], some, 20)
    assert all(of_query(found, i) == plain_best(v, np.arange(4000), q) for i, q in enumerate(some))
    assert tree.scored < 0.25 * len(some) * len(v)


@pytest.mark.parametrize("shard", [16, 8192])
def test_top_k_of_large_components(spark, shard):
    far = [[1e12, 2.0], [1e300, 2.0], [-1e300, 0.0], [3e9, 5.0], [1.0, 1.0], [2.0**52, 1.0]] + [[float(i), 3e10] for i in range(40)]
    e = spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>")
    v = np.array([[int(64 * x) for x in r] for r in far], object)
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    want = set()
    for q in (0, 20, 40):
        found = sorted(((clip(sum(a * b for a, b in zip(v[q], v[i], strict=True))), -i) for i in range(len(v)) if i != q), reverse=True)
        want |= {(q, r + 1, -i, s) for r, (s, i) in enumerate(found[:20])}
    assert {tuple(r) for r in topk.top_k(e, F.col("vec_id") % 20 == 0, shard=shard, page=4).collect()} == want


def test_top_k_visits_few_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (12, 8))
    v = np.repeat(centres, 60, axis=0) + rng.normal(0, 0.01, (720, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    whole = np.floor(64 * v)
    got = {}
    for r in topk.top_k(e, F.col("vec_id") % 20 == 0, shard=60, group=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 720, 20):
        assert sorted(got[q]) == [(k + 1, i, s) for k, (i, s) in enumerate(plain_best(whole, np.arange(720), q))]
    metric = topk.Metric.of(whole)
    points = metric.points(whole)
    routing = points[topk.spread(points, 12)]
    d = topk.distances(points, routing)
    radii = np.array([d[d.argmin(axis=1) == p, p].max() for p in range(12)])
    asks = np.arange(0, 720, 20)
    frame = __import__("pandas").DataFrame({"vec_id": asks, "v": [whole[q] for q in asks], "h": asks, "floor": [float(plain_best(whole, np.arange(720), q)[-1][1]) for q in asks]})
    visits = sum(map(len, topk._router(metric, routing, radii, np.arange(12), np.ones(12, int), False)(iter([frame]))))
    assert visits < 0.3 * len(asks) * 11


@pytest.mark.parametrize("shard", [10, 8192])
def test_top_k_of_ids_with_several_vectors(spark, tmp_path, shard):
    rng = np.random.default_rng(6)
    ids = [0] * 3 + [20] * 2 + [7] * 60 + [int(i) for i in rng.integers(1, 60, 115)]
    near = [[float(x) for x in (rng.integers(40, 60, 4) if i == 7 else rng.integers(-40, 40, 4))] for i in ids]
    e = spark.createDataFrame(list(zip(ids, near, strict=True)), "vec_id long, embedding array<double>")
    e.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    got = topk.top_k(e, F.col("vec_id") % 20 == 0, shard=shard, page=8).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["op6_exact_topk"]).fetchall())


def test_top_k_leaves_out_bad_vectors(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0, None]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(e, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 20, 64 * 32 + 128 * 32), (20, 1, 0, 64 * 32 + 128 * 32)}
    assert topk.top_k(e.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(items))]


def test_simhash(spark, sf, real):
    got = rows(QUERIES["op7_simhash_dedup"](spark, sf))
    prints = [plain_fingerprint(t) for _, t in real]
    roots = plain_components(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    for (doc_id, _), p, r in zip(real, prints, roots, strict=True):
        assert (got[doc_id]["fingerprint"], got[doc_id]["component_id"]) == (f"{p:016x}", real[r][0])


def test_grid_points_meet_exactly_within_two(spark):
    rng = np.random.default_rng(15)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)] + [0, (1 << 64) - 1]
    prints += [p ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for p in prints[-12:] for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(prints)], "i int, fp long").withColumn("emb", simhash.segment_popcounts(F.col("fp")))
    got = [set(r["at"]) for r in df.select("i", simhash.grid_points(F.col("emb")).alias("at")).orderBy("i").collect()]
    digits = [[(p >> s & 15).bit_count() for s in range(0, 64, 4)] for p in prints]
    for i in range(len(prints)):
        for j in range(i):
            apart = sum(abs(x - y) for x, y in zip(digits[i], digits[j], strict=True))
            assert bool(got[i] & got[j]) == (apart <= 2) and apart <= (prints[i] ^ prints[j]).bit_count()


def test_simhash_takes_rows_of_one_id_as_one_node(spark):
    docs = [(3, LONG), (5, LONG), (5, "one two three four"), (7, "one two three four"), (9, "five six seven"), (None, "five six seven")]
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 9), (3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]


@pytest.mark.parametrize("cell", [1, 4, 32])
def test_simhash_crowded_cells_lose_no_link(spark, cell):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    prints = sorted({c ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for c in centres for k in (0, 1, 2, 3, 4) for _ in range(12)})
    reps = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(prints)], "rep long, fp long")
    from lodestone.operators.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(reps, cell)).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == plain_components(prints, lambda x, y: (x ^ y).bit_count() <= 2)


def test_merged_transforms_against_a_dictionary():
    rng = np.random.default_rng(5)
    for _ in range(40):
        base = bytes(rng.choice(list(b"ab"), 60))
        strings = [base[a : a + n] + bytes(rng.choice([0, 97, 244], 5)) for a, n in rng.integers(0, 30, (int(rng.integers(1, 12)), 2))]
        block, c = bwt.repeats(strings, 8)
        number = {}
        for i, s in enumerate(strings):
            for o in range(len(s) - 7):
                assert number.setdefault(s[o : o + 8], block[c.begins[i] + o]) == block[c.begins[i] + o]
        assert len(set(number.values())) == len(number)


def plain_removal(docs):
    seen, out = set(), {}
    for doc_id, text in docs:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                covered[i : i + 100] = True
            seen.add(s)
        edges = np.diff(np.concatenate(([0], covered.astype(int))))
        left = bytes(np.frombuffer(data, np.uint8)[~covered])
        out[doc_id] = (len(data), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_repeats(spark, sf, real):
    got = rows(QUERIES["op8_suffix_dedup"](spark, sf))
    for doc_id, want in plain_removal(real).items():
        assert tuple(got[doc_id])[1:] == want


def test_repeats_of_awkward_texts(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    passage = word(130)
    docs = [(1, "x" * 700), (2, "ab" * 300 + passage), (3, None), (4, passage + "x" * 150), (5, word(40) + passage[:101] + word(9) + passage[20:]), (6, passage[:99]), (7, ""), (8, "abc" * 200 + "ab" * 60)]
    docs += [(10 + i, word(int(rng.integers(0, 80))) + passage[int(rng.integers(0, 10)) :] + word(30)) for i in range(20)]
    got = rows(exact_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    for doc_id, want in plain_removal(docs).items():
        assert tuple(got[doc_id])[1:] == want, doc_id


def test_repeats_of_unnamed_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    one, two, three = ("".join(rng.choice(list("abcdefgh"), 400)) for _ in range(3))
    docs = [(1, one)] * 40 + [(2, three + one[:200])] * 30 + [(None, two), (None, two), (None, three), (None, one[100:300])]
    got = exact_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got)
    assert found == [(0, 200, 200, 1), (0, 400, 0, 0), (0, 400, 0, 0), (0, 400, 400, 1)] + [(1, 400, 0, 0)] * 40 + [(2, 600, 200, 1)] * 30


def plain_removal_by_node(docs):
    """n_removed of each row where ids may repeat: by a smaller id, or before in the same text."""
    first, out = {}, []
    for doc_id, text in docs:
        data = text.encode()
        for i in range(len(data) - 99):
            first[data[i : i + 100]] = min(first.get(data[i : i + 100], doc_id), doc_id)
    for doc_id, text in docs:
        data, seen, gone = text.encode(), set(), set()
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if first[s] < doc_id or s in seen:
                gone |= set(range(i, i + 100))
            seen.add(s)
        out.append((doc_id, len(data), len(gone)))
    return sorted(out)


@pytest.mark.parametrize("crowd", [1, 256])
def test_repeats_of_ids_with_several_texts(spark, crowd):
    rng = np.random.default_rng(11)
    x, y, z = ("".join(rng.choice(list("abcdefgh"), 300)) for _ in range(3))
    docs = [(1, x), (2, x), (2, y), (3, y[50:] + z), (3, z + "tail" * 30), (3, z + "tail" * 30), (4, z), (4, y[:150] + z[100:])]
    got = exact_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == plain_removal_by_node(docs)


@pytest.mark.parametrize("n", [60, 10_000])
def test_repeats_of_a_passage_in_many_contexts(spark, n):
    rng = np.random.default_rng(12)
    passage = "".join(rng.choice(list("abcdefghij "), 260))
    letters = np.array(list("klmnopqrstuv "))
    docs = [(i, "".join(rng.choice(letters, 90)) + passage[int(rng.integers(0, 3)) :] + "".join(rng.choice(letters, 70))) for i in range(n)]
    got = rows(exact_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)))
    for doc_id, want in plain_removal(docs).items():
        assert tuple(got[doc_id])[1:] == want, doc_id


def test_segments_without_a_shared_context_share_no_window():
    from lodestone.llm import passages

    rng = np.random.default_rng(13)
    base = bytes(rng.choice(list(b"abcdefgh"), 400))
    texts = [bytes(rng.choice(list(b"xyz"), int(a))) + base[a : a + n] + bytes(rng.choice(list(b"xyz"), 60)) for a, n in rng.integers(20, 200, (60, 2))]
    s = passages.segments(texts)
    pieces = [texts[t][a : a + n + 99] for t, a, n in zip(s.text, s.start, s.n, strict=True)]
    seen = {}
    for i, p in enumerate(pieces):
        for o in range(len(p) - 99):
            seen.setdefault(p[o : o + 100], []).append(i)
    shares = {i for v in seen.values() if len(v) > 1 for i in v}
    may = passages.contexts(pieces, s.key)
    assert shares <= set(np.flatnonzero(may)) and not may.all()


def test_mixing_meets_its_targets(spark, sf):
    got = QUERIES["op9_mixing"](spark, sf).collect()
    total = sum(r["n_tokens"] * r["rate"] for r in got)
    for d, share in mixing.TARGETS.items():
        assert sum(r["n_tokens"] * r["rate"] * (r[f"p_{d}"] or 0) for r in got) / total == pytest.approx(share, abs=1e-3)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"] + 1e-3), int(r["rate"]) + 1) for r in got)


@pytest.mark.parametrize("total", [None, 500.0])
def test_mixing_against_numpy(spark, total):
    rng = np.random.default_rng(17)
    vocabulary = {d: [f"{d}{i}" for i in range(30)] + ["both"] * 6 for d in ("en", "fr", "de")}
    docs = [(i, " ".join(rng.choice(vocabulary[d], int(rng.integers(1, 60))).tolist() + rng.choice(vocabulary["fr"], int(rng.integers(0, 6))).tolist()), d) for i, d in enumerate(rng.choice(["en", "en", "en", "fr", "de"], 120).tolist())]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    targets = {"en": 0.4, "fr": 0.35, "de": 0.25}
    got = rows(mixing.document_rates(df, df.select("text", F.col("lang").alias("domain")), targets, total=total))
    words = sorted({w for _, t, _ in docs for w in t.split()})
    hashed = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    names = list(targets)
    table = np.full((mixing.BUCKETS, 3), mixing.SMOOTHING)
    for _, t, d in docs:
        for w in t.split():
            table[hashed[w], names.index(d)] += 1
    log_p = np.log(table / table.sum(axis=0))
    size = np.array([len(t.split()) for _, t, _ in docs], float)
    logits = np.array([log_p[[hashed[w] for w in t.split()]].sum(axis=0) * min(mixing.EVIDENCE, len(t.split())) / len(t.split()) for _, t, _ in docs])
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose([[got[i][f"p_{d}"] for d in names] for i in range(120)], p, atol=1e-9)
    rate = np.array([got[i]["rate"] for i in range(120)])
    mass = (size * rate) @ p
    aim = np.array(list(targets.values()))
    assert np.allclose(mass / mass.sum(), aim, atol=1e-5) and rate.min() >= (1.0 if total is None else 0.0)
    if total is not None:  # least squares from rate 1: the same projected steps in NumPy
        assert mass.sum() == pytest.approx(total, rel=1e-5)
        share, r = size @ p / size.sum(), np.ones(120)
        for _ in range(2000):
            off = ((size * r) @ p / size.sum() - aim * total / size.sum()) / share
            r = np.maximum(0, r - p @ off)
        assert np.allclose(r, rate, atol=1e-3)


def test_mixing_says_what_it_missed(spark):
    docs = spark.createDataFrame([(i, "the la", "en" if i % 3 else "fr") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="missed by up to"):
        mixing.document_rates(docs, docs.select("text", F.col("lang").alias("domain")), {"en": 0.2, "fr": 0.8}).collect()


def test_mixing_drops_no_document_for_soft_ones(spark):
    pure = [(i, f"the and of with house{i % 7}", "en") for i in range(400)] + [(400 + i, f"le la et avec maison{i % 7}", "fr") for i in range(40)]
    soft = [(500 + i, "the la of avec" if i % 3 else "the et", "fr" if i % 2 else "en") for i in range(80)]
    docs = spark.createDataFrame(pure + soft, "doc_id long, text string, lang string")
    labelled = docs.select("text", F.col("lang").alias("domain"))
    got = mixing.document_rates(docs, labelled, {"en": 0.6, "fr": 0.4}).withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).collect()
    assert len(got) == 520 and min(r["rate"] for r in got) >= 1 and min(r["copies"] for r in got) >= 1
    total = sum(r["n_tokens"] * r["rate"] for r in got)
    assert sum(r["n_tokens"] * r["rate"] * r["p_en"] for r in got) / total == pytest.approx(0.6, abs=1e-3)
    # equal documents leave no choice: the total must not run away
    same = spark.createDataFrame([(i, "the la", "en" if i % 3 else "fr") for i in range(30)], "doc_id long, text string, lang string")
    rates = [r["rate"] for r in mixing.document_rates(same, same.select("text", F.col("lang").alias("domain")), {"en": 0.2, "fr": 0.8}).collect()]
    assert min(rates) >= 1 and max(rates) < 20


def test_packing(spark, sf, real):
    got = QUERIES["op10_packing"](spark, sf).collect()
    encoder = packing.Encoder(tokenizer_path())
    want = {}
    for doc_id, text in real:
        ids = np.array(encoder.exact.encode(text, add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if first else [*range(0, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, piece] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) * 1.02 + 1


@pytest.mark.parametrize("text", ["a  b", "a\n b", "x <|endoftext|> y", " a", "a ", "", "\0a b", "a\tb c’s é ñ", "  ", "a \nb", "don't 12 345!!"])
def test_encoder_equals_the_tokenizer(text):
    encoder = packing.Encoder(tokenizer_path())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def test_swaps_empty_bins():
    sizes = [6, 6, 5, 5, 4, 4]  # 30 in three bins of 10; one too many to begin with
    bins = packing.swap_search(sizes, [0, 1, 2, 2, 3, 3], 10)
    assert len(set(bins)) == 3
    assert packing.best_fit([7, 3, 5, 5], 10)[0] == packing.best_fit([7, 3, 5, 5], 10)[1]


def test_search_empties_bins_that_best_fit_leaves():
    sizes = [4, 4, 4, 3, 3, 3, 3, 3, 3]  # best fit takes four bins of 10, and three do
    assert len(set(packing.best_fit(sizes, 10))) == 4 and len(set(packing.pack_items(sizes, 10))) == 3
    rng = np.random.default_rng(8)
    emptied = 0
    for low, high, capacity, n in [(20, 50, 100, 60), (30, 69, 100, 300), (1, 60, 100, 200), (340, 699, 1024, 600), (5, 9, 20, 90)] * 4:
        sizes = rng.integers(low, high + 1, n).tolist()
        before, after = packing.best_fit(sizes, capacity), packing.pack_items(sizes, capacity)
        assert max(np.bincount(after, sizes)) <= capacity and len(set(after)) <= len(set(before))
        emptied += len(set(before)) - len(set(after))
    assert emptied > 0


def test_search_raises_the_squared_fill_and_leaves_no_step():
    rng = np.random.default_rng(10)
    for _ in range(20):
        sizes, capacity = rng.integers(2, 15, 24).tolist(), 20
        bins = packing.best_fit(sizes, 15)  # loose to begin with
        after = packing.swap_search(sizes, bins, capacity)
        fill = lambda x: np.bincount(x, sizes, max(bins) + 1).astype(int)
        a, b = fill(bins), fill(after)
        assert b.max() <= capacity and b.sum() == a.sum() and (b**2).sum() >= (a**2).sum()
        if (b > 0).sum() == -(-sum(sizes) // capacity):
            continue
        own = {c: [s for s, x in zip(sizes, after, strict=True) if x == c] for c in set(after)}
        some = lambda c, n: [sum(x) for k in n for x in __import__("itertools").combinations(own[c], k)]
        for e in own:
            for c in own:
                if c != e and b[e] <= b[c] < capacity:
                    steps = [x - y for give, take in (((1, 2), (0, 1)), ((1,), (2,))) for x in some(e, give) for y in some(c, take)]
                    assert not any(0 < net <= capacity - b[c] for net in steps) or b[e] == b[c]


def test_packing_of_odd_items(spark):
    items = spark.createDataFrame([(None, "a", 1), (-3, "b", 2), (2000, "c", 3), (1024, "d", 4), (5, None, 5), (5, None, 5)], "length long, __shard string, offset int")
    out = packing.pack(items).collect()
    assert sorted(items.drop("offset").columns) == sorted(set(out[0].asDict()) - {"sequence_id", "offset"}) and len(out) == 6
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert [2000] in by.values() and sum(x or 0 for v in by.values() for x in v if (x or 0) > 0) == 3034


def test_packing_in_many_shards(spark):
    items = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"), "id")
    out = packing.pack(items, shard=300).collect()
    assert sorted(r["id"] for r in out) == list(range(3000))
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= 1.03 * sum(fill.values()) / 1024


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.drop_toxic(spark, docs, sf)
    single = p.drop_near_duplicates(spark, clean, sf)
    heads = {r["component_id"] for r in simhash.near_duplicates(clean).collect()}
    assert {r["doc_id"] for r in single.collect()} == heads
    masked = rows(p.mask_secrets(spark, single, sf))
    for r in single.collect():
        assert masked[r["doc_id"]]["text"] == secrets.redact(r["text"]) and masked[r["doc_id"]]["n_chars"] == len(masked[r["doc_id"]]["text"])
    assert {r["doc_id"] for r in p.mix_domains(spark, single, sf).collect()} == heads
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == heads
    assert all(f(spark, docs, sf).columns == docs.columns for _, f in p.STAGES[:-1])
