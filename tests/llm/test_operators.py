import hashlib
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.llm import common, license_scan, media, mixing, ngram_join, pii, quality_rules, sentencepiece_lattice, token_store, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, ids string, copies int, kept string, component_id string, _row int"
LONG = " ".join(f"w{i % 997} of" for i in range(60_000))
TEXTS = ["one two three four five", None, "", " \t\n ", LONG, "same text here " * 20, "same text here " * 20, "Mail a.b@c.de at +1 (988) 555-2485, ip 1.2.3.4!", "ünïcödé ▁ 日本語 😀 \x1f x\x85y"]


def rows(texts=TEXTS):
    out = [(i, t, "en", None if i % 4 == 3 else f"s{i % 3}", 1, 7, 0.5, "i", 3, "k", "c", 0) for i, t in enumerate(texts)]
    return [*out, out[5], (None, "no id at all", "en", "s1", 1, 7, 0.5, "i", 3, "k", "c", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "op1": lambda d: sentencepiece_lattice.digests(sentencepiece_lattice.encode_documents(d, sentencepiece_lattice.default_model()), sentencepiece_lattice.default_model()),
    "op2": pii.find_personal_data,
    "op2r": pii.redact_documents,
    "op3": ngram_join.link_documents,
    "op4": lambda d: token_store.read_tokens(token_store.write_tokens(d, token_store.default_tokenizer())),
    "op5": license_scan.scan,
    "op6": quality_rules.judge,
    "op7": lambda d: toxicity.score(d, toxicity.fit_rows([])),
    "op9": lambda d: media.media_features(media.store_media(d)),
    "op10": mixing.with_copies,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(docs, empty, name):
    got = OPERATORS[name](docs).collect()
    assert len(got) == len(rows()) and len({r.doc_id for r in got}) == len(TEXTS) + 1
    assert len({str({k: v for k, v in r.asDict().items() if k not in ("start", "copies", "taken")}) for r in got if r.doc_id == 5}) == 1
    assert OPERATORS[name](empty).count() == 0


def mutated(rnd, n=60):
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 300)) for _ in range(rnd.choice([3, 4, 9, 12, 40, 120, 400]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9)}"
        out.append(" ".join(w.upper() if rnd.random() < 0.3 else w for w in words))
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def plain_groups(texts, part=85):
    """(set sizes, least member of each text's group, equal others) from all pairs."""
    sets = [shingles(t) for t in texts]
    links = [{j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= part * len(a | b)} for i, a in enumerate(sets)]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min([comp[i], *(comp[j] for j in links[i])]) for i in range(len(texts))]
    return [(len(a), c, sum(b == a for b in sets) - 1 if a else 0) for a, c in zip(sets, comp, strict=True)]


def grouped(spark, texts):
    got = ngram_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [(r.n_shingles, r.component_id, r.n_copies) for r in got]


def test_ngram_join_against_all_pairs(spark):
    texts = [*mutated(random.Random(5), 160), "", "only one"]
    want = plain_groups(texts)
    assert grouped(spark, texts) == want
    assert sum(c != i for i, (_, c, _) in enumerate(want)) > 50


def drifting(rnd, n, words, step):
    """Texts each of which changes a few words of the one before: neighbours are linked, far ones aren't."""
    held, out = [f"{rnd.random()}" for _ in range(words)], []
    for i in range(n):
        for k in range(step):
            held[(i * step + k) * 37 % words] = f"n{i}-{k}-{rnd.random()}"
        out.append(" ".join(held))
    return out


def test_large_groups_are_joined_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 7)
    rnd = random.Random(2)
    words = [f"t{i}" for i in range(150)]
    near = [" ".join(w if k != i else "new" + str(rnd.random()) for k, w in enumerate(words)) for i in range(40)]
    chain = drifting(rnd, 60, 120, 1)
    loose = drifting(rnd, 30, 120, 4)  # at the threshold
    texts = [*near, *chain, *loose, *near[:3]]
    rnd.shuffle(texts)
    want = plain_groups(texts)
    assert grouped(spark, texts) == want and len({c for _, c, _ in want}) > 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == sorted({c for _, c, _ in want})


def test_shuffle_files_go_with_their_query(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" "))}

    before = shuffled()
    table = common.staged(spark.range(10_000).repartition("id").groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and sorted(r.k for r in table.collect()) == list(range(7))
    common.discard(table)
    assert not any(n.startswith("freed-") for n in os.listdir(common.shared_root(spark)))


def test_wide_tables_of_the_join_go_before_its_end(spark):
    before = set(os.listdir(common.shared_root(spark)))
    docs = spark.createDataFrame(list(enumerate(mutated(random.Random(6), 60))), "doc_id long, text string")
    rows = ngram_join.link_documents(docs)
    left = {re.sub(r"-[0-9a-f]{32}$", "", n) for n in set(os.listdir(common.shared_root(spark))) - before}
    assert not left & {"ngram", "ngram-met", "ngram-blocks", "ngram-sets"} and "ngram-keys" in left
    assert rows.count() == docs.count()


def test_pairs_of_chunks_are_dealt_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 2000)
    names = []
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: names.append(name) or common.staged(df, name))
    rnd = random.Random(2)
    texts = [*drifting(rnd, 60, 120, 1), *drifting(rnd, 30, 120, 4)]
    rnd.shuffle(texts)
    assert grouped(spark, texts) == plain_groups(texts)
    assert names.count("ngram-met") == ngram_join.ROUNDS and names.count("ngram-links") > 3


def test_keep_one_takes_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b + " tail"), (None, c), (None, c), (None, c + " more"), (3, ""), (3, None), (None, "")]
    got = ngram_join.keep_one(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got if r.text != c and r.text != c + " more") == sorted((str(i), str(t)) for i, t in [(1, a), (1, b), (3, ""), (3, None), (None, "")])
    assert sum(r.text in (c, c + " more") for r in got) == 1 and got[0].__fields__ == ["doc_id", "text", "key"]
    linked = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in linked if r.doc_id is None} == {None} and len(linked) == len(rows)


def test_signature_trees_find_every_pair():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(50)]
    sets += [np.unique(np.concatenate([s[:190], rnd.integers(0, 2**63, 8).astype(np.uint64)])) for s in sets]
    for split in (0, 50):
        i, j = ngram_join.join_sets(sets, split)
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == {(k, k + 50) for k in range(50)}


def test_sentencepiece_equals_the_library(docs):
    import sentencepiece

    path = sentencepiece_lattice.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_lattice.Lattice(path)
    rnd = random.Random(3)
    pieces = list(own.ids)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))).replace("▁", " ") for _ in range(200)] + ["a" * 3000, "  x  ", "\x00", "𝔘 ﬁ"]
    want = library.encode(texts)
    assert [g.tolist() for g in own.encode(texts)] == want
    assert [own.decode(w) for w in want] == [library.decode(w) for w in want]
    assert not own.odd.any()  # so no pair of pieces needs the slow test


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(docs):
    rnd = random.Random(4)
    for _ in range(3000):
        text = "".join(rnd.choice("0123456789...--+ @ab()  ") for _ in range(rnd.randint(0, 90)))
        base, every = pii.find_spans(text, pii.trained())
        assert base == plain_spans(text) and set(base) <= set(every)
    hit = miss = wrong = 0
    for text, spans in pii._examples(random.Random(99)):
        base, every = pii.find_spans(text, pii.trained())
        got, want = set(every) - set(base), set(spans) - set(base)
        hit, miss, wrong = hit + len(got & want), miss + len(want - got), wrong + len(got - want)
    assert hit > 300 and miss + wrong < 0.05 * hit
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert (got[7].n_email, got[7].n_ip, got[7].n_phone) == (1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert pii.redact("a@b.co, x", [("email", 0, 6)]) == "[EMAIL], x"


def test_the_programme_against_all_segmentations():
    model, seen = pii.trained(), 0
    for text, _ in pii._examples(random.Random(5)):
        for region in pii._regions(text + " 12 34 56 78 901 2345"):
            if len(region) > 9:
                continue
            options = [(s, kind, score) for s in region for kind, score in zip(pii.KINDS, model.scores(s), strict=True)]
            best, total = 0.0, 0.0
            for n in range(4):
                for pick in itertools.combinations(options, n):
                    spans = sorted((s.first, s.last) for s, _, _ in pick)
                    if all(a[1] < b[0] for a, b in itertools.pairwise(spans)):
                        value = sum(x for _, _, x in pick)
                        best, total = max(best, value), total + np.exp(value)
            if max(s.last for s in region) > 3:  # more than three segments may fit
                continue
            found = sum(dict(zip(pii.KINDS, model.scores(s), strict=True))[k] for s, k in model.best(region))
            ahead, behind = model.sums(region, [model.scores(s) for s in region])
            assert found == pytest.approx(best) and ahead[-1] == pytest.approx(np.log(total)) and behind[0] == pytest.approx(ahead[-1])
            seen += 1
    assert seen > 100


SAID = [
    ("my deploy notes: api_key=Zk39fLq02mXv8TtRb71c ok", "secret", "Zk39fLq02mXv8TtRb71c"), ('export TOKEN="9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"),
    ("please call 2125550187 after six", "phone", "2125550187"), ("Tel. (212) 555-0187, ask for Ann", "phone", "(212) 555-0187"), ("write to ann.lee [at] example [dot] org", "email", "ann.lee [at] example [dot] org"),
    ("amex 378282246310005 on file", "card", "378282246310005"), ("server 10 . 0 . 0 . 1 is down", "ip", "10 . 0 . 0 . 1"),
]
CLEAN = ["built from commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b today", "order 2125550187 has shipped", "number 9807915762804490 of the series", "in 1998 and 2004, on 12.05.2011", "see chapter-12-of-the-long-book", "we met at noon.then left"]


def test_sentences_that_no_generator_made():
    model = pii.trained()
    for text, kind, span in SAID:
        assert (kind, text.index(span), text.index(span) + len(span)) in pii.find_spans(text, model)[1], text
    assert [t for t in CLEAN if pii.find_spans(t, model)[1]] == []


def test_long_runs_take_linear_time():
    for text in ("7" * 1_000_000, "a1" * 500_000, "a" * 1_000_000, "+1 " * 100_000, "1." * 20_000):
        began = time.process_time()
        pii.find_spans(text, pii.trained())
        assert time.process_time() - began < 3


def test_token_store(docs, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.default_tokenizer())
    encoder = token_store.WordEncoder(token_store.default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["It's <|endoftext|> don't 3.14 ΣΑΣ İx é ﬁ", "A\x1cB c"]
    ids, counts = encoder.encode(texts)
    want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
    for n in (1, 2, 2047, 2048, 2049, len(ids)):
        data = token_store.write_file(ids[:n], np.array([n]))
        assert token_store.read_file(data)[0].tolist() == ids[:n].tolist()
    with pytest.raises(ValueError):
        token_store.read_file(data[:-40] + bytes([data[-40] ^ 255]) + data[-39:])
    got = {r.doc_id: r for r in OPERATORS["op4"](docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        w = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(w), zlib.crc32(w.tobytes()))
        start += len(w)


def test_repeated_notices_take_linear_time(spark):
    notice = license_scan.TEMPLATES["MIT-text"] + " "
    began = time.time()
    got = license_scan.scan(spark.createDataFrame([(1, notice * 400)], "doc_id long, text string")).first()
    assert "MIT-text" in got.licenses.split(",") and got.best == 1.0 and time.time() - began < 60


def test_license_scan(spark):
    body = license_scan.TEMPLATES["MIT-text"].split()
    near = " ".join("changed" if i == 20 else w for i, w in enumerate(body))
    far = " ".join("changed" if i % 6 == 0 else w for i, w in enumerate(body))
    texts = [f"aa bb {near} cc", far, "x RELEASED under\nthe MIT, license!", "released under a mit license", license_scan.TEMPLATES["Apache-2.0-header"]]
    got = [r.licenses for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT-text", "", "MIT", "", "Apache-2.0,Apache-2.0-header"]
    whole = [license_scan.TEMPLATES[k] for k in ("MIT-whole", "BSD-2-Clause", "Zlib")]
    got = [r.licenses for r in license_scan.scan(spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT-text,MIT-whole", "BSD,BSD-2-Clause", "Zlib"]


def plain_repeats(text):
    w = text.split(" ")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    return len({p for i, x in enumerate(tri) if many[x] > 1 for p in (i, i + 1, i + 2)})


def test_repeat_words(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 60))) for _ in range(60)] + [" ".join(str(i) for i in range(50)) * 2]
    got = quality_rules.measures(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [plain_repeats(t) for t in texts]


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    data = [(i, "bad" if i < 40 else "fine", "junk" if i < 38 else good) for i in range(400)]
    got = quality_rules.judge(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(40, 400))
    lost = spark.createDataFrame([(i, None if i < 50 else "fine", None if i < 49 else good) for i in range(100)] * 2, "doc_id long, source string, text string")
    assert {r.doc_id for r in quality_rules.judge(lost).collect() if r.kept} == set(range(50, 100))  # the null host is one host


def test_toxicity_is_learned(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 4)))
    data, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[3] = rnd.choice(["grumpf", "zonkhaft", "zonkling", "zonkmann"])
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 300 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum((r.predicted == 1) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.score == pytest.approx(toxicity.score_text(model, r.text)) for r in got[:50])


def plain_em(votes, gold):
    """The label model of independent voters, a row and a voter at a time."""
    n, m = len(votes), len(votes[0])
    sig = lambda z: 1 / (1 + np.exp(-min(30, max(-30, z))))
    ones = sum(gold)
    own = [np.log(((sum(g for v, g in zip(votes, gold) if v[j]) + 0.5) / (ones + 1)) / ((sum(1 - g for v, g in zip(votes, gold) if v[j]) + 0.5) / (n - ones + 1))) for j in range(m)]
    z, said = [np.log(1 / 9) + sum(own[j] for j in range(m) if v[j]) for v in votes], [0.0] * n
    p = [sig(x) for x in z]
    for _ in range(toxicity.ROUNDS):
        n1 = sum(p)
        n0 = n - n1
        hits = [sum(sig(z[i] - own[j]) for i in range(n) if votes[i][j]) for j in range(m)]
        fired = [sum(v[j] for v in votes) for j in range(m)]
        own = [np.log(((hits[j] + 0.5 * n1 / n) / (n1 + 0.5)) / ((fired[j] - hits[j] + 0.5 * n0 / n) / (n0 + 0.5))) for j in range(m)]
        heard = [sig(z[i] - said[i]) for i in range(n)]
        a = (sum(h * g for h, g in zip(heard, gold)) + 0.5) / (sum(heard) + 1)
        b = (sum((1 - h) * g for h, g in zip(heard, gold)) + 0.5) / (n - sum(heard) + 1)
        mute = [i for i in range(n) if not any(votes[i])]
        none = np.log((sum(heard[i] for i in mute) + 0.5) / (sum(heard) + 1)) - np.log((sum(1 - heard[i] for i in mute) + 0.5) / (n - sum(heard) + 1))
        said = [np.log(a / b) if g else np.log((1 - a) / (1 - b)) for g in gold]
        prior = min(0.5, max(1e-3, n1 / n))
        z = [np.log(prior / (1 - prior)) + sum(own[j] for j in range(m) if v[j]) + (none if i in mute else 0) + said[i] for i, v in enumerate(votes)]
        before, p = p, [sig(x) for x in z]
        if max(abs(x - y) for x, y in zip(p, before)) < toxicity.SETTLED:
            break
    return p


def some_votes(rng, n, m, wrong):
    truth = rng.random(n) < 0.3
    votes = (rng.random((n, m)) < np.where(truth[:, None], rng.uniform(0.3, 0.7, m), rng.uniform(0, 0.004, m))).astype(np.float32)
    return truth, votes, np.where(rng.random(n) < wrong, ~truth, truth).astype(int)


def test_label_model_against_a_plain_em(monkeypatch):
    monkeypatch.setattr(toxicity, "CORRELATED", 2.0)  # no correlation is that large
    _, votes, gold = some_votes(np.random.default_rng(3), 120, 9, 0.1)
    assert toxicity.label_model(votes, gold)[0] == pytest.approx(plain_em(votes.astype(int).tolist(), gold.tolist()), abs=1e-6)


def test_voters_outvote_wrong_labels():
    truth, votes, gold = some_votes(np.random.default_rng(4), 3000, 40, 0.1)
    p, on1, on0 = toxicity.label_model(votes, gold)
    wrong = gold != truth
    assert wrong.sum() > 200 and ((p >= 0.5) == truth)[wrong].mean() > 0.85 and ((p >= 0.5) == truth).mean() > (gold == truth).mean() + 0.03
    # a lone vote is believed too much, as voters that are silent count only where all are; so the rates come out too far apart from 1
    assert 0.6 < on1[-1] <= gold[truth].mean() + 0.03 and on0[-1] == pytest.approx(gold[~truth].mean(), abs=0.05)
    assert np.corrcoef(on1[:-1], votes[truth].mean(0))[0, 1] > 0.95
    copied = np.concatenate([votes, np.repeat(votes[:, :1], 30, axis=1)], axis=1)  # one voter thirty times more
    q = toxicity.label_model(copied, gold)[0]
    assert ((q >= 0.5) == truth).mean() > (gold == truth).mean() + 0.03


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot moron"), (2, "a kind word"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")):
        got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
        assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.fit(docs.limit(0), none)["weights"]


def test_warc_of_long_and_repeated_pages(spark):
    long, big = "<p>" + "ab cd " * 3_000_000, "y" * 1500
    pages = [(1, "u", long, "x"), (2, "u", long, "x"), (7, "u", big, "x"), (7, "u", big, "x"), (3, "u", big, "x")]
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string, data string"))).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 7), (7, "response", None), (7, "response", None)]


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = [(1, "u1", big), (2, "u2", big), (9, None, big), (3, "a\r\nb", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big)]
    archives = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: r for r in warc.read_warc(archives).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), None: ("revisit", 9), 9: ("response", None), **{k: ("response", None) for k in (3, 4, 5, 6)}}
    assert got[1].payload_bytes == len(big) and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[5].payload_bytes == 0
    assert warc.export(archives, str(tmp_path)) == archives.count()
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    recs = [warc.record(i, "u", bytes([65 + i % 26]) * i, None) for i in range(300)]
    data = warc.write_archive(recs)
    assert list(warc.read_archive(data)) == recs and data[:4] == b"\x5d\x2a\x4d\x18"


@pytest.mark.parametrize("bpp", [1, 3])
def test_all_png_filters(bpp):
    rnd = np.random.default_rng(0)
    want = rnd.integers(0, 256, (40, 12 * bpp)).astype(np.uint8)
    kinds = rnd.integers(0, 5, 40)
    lines = np.zeros((40, 12 * bpp + 1), np.uint8)
    for y, kind in enumerate(kinds):
        lines[y, 0] = kind
        for x in range(12 * bpp):
            a, b, c = (int(want[y, x - bpp]) if x >= bpp else 0), (int(want[y - 1, x]) if y else 0), (int(want[y - 1, x - bpp]) if y and x >= bpp else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            lines[y, x + 1] = (int(want[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255
    assert np.array_equal(media.unfilter(lines, bpp), want)


def plain_hash(rows):
    """The hash by sums over single pixels and frequencies."""
    def bands(x):
        out = np.zeros((32, x.shape[1]))
        for k in range(32):
            lo, hi = k * len(x) / 32, (k + 1) * len(x) / 32
            for y in range(int(lo), min(len(x), int(np.ceil(hi)))):
                out[k] += x[y] * (min(y + 1, hi) - max(y, lo)) / (hi - lo)
        return out

    small = bands(bands(rows.astype(float)).T).T
    grid = np.arange(32) + 0.5
    low = [round(float((small * np.outer(np.cos(np.pi / 32 * grid * u), np.cos(np.pi / 32 * grid * v))).sum()), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if x > middle else "0" for x in low)
    return f"{int(bits, 2):016x}"


def test_media(docs):
    got = {r.doc_id: r for r in OPERATORS["op9"](docs).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        image = media.write_png(payload)
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == (len(image), hashlib.sha256(image).hexdigest(), plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 192)))
    png = media.write_png(b"a" * 1920)
    assert media.read_png(png).tobytes() == b"a" * 1920
    with pytest.raises(ValueError):
        media.read_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])


def test_mixing(spark):
    rnd = random.Random(9)
    sizes = {k: rnd.randint(20, 4000) for k in ["a", "b", "c", "d", "é", "Z", None]}
    data = [(i, " ".join(["w"] * rnd.randint(0, 30)), k) for k, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(j, t, k) for j, (_, t, k) in enumerate(data)], "doc_id long, text string, source string")
    got = mixing.with_copies(docs).collect()
    total = {k: sum(len(t.split()) for _, t, x in data if x == k) for k in sizes}
    order = sorted([k for k in total if k is not None], key=lambda s: [ord(c) for c in s]) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    goal, free = {}, dict(total)
    rest = 1.5 * sum(total.values())
    while True:
        level = rest / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 2 * free[k]]
        if not over:
            break
        for k in over:
            goal[k] = 2.0 * free.pop(k)
            rest -= goal[k]
    goal |= {k: level * weight[k] for k in free}
    for k in sizes:
        mine = [r for r in got if r.source == k]
        assert all(r.target == pytest.approx(goal[k]) and 0 <= r.copies <= 2 and r.source_size == total[k] for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[k]) <= 0.05 * goal[k] + 60
    rows = [(k % 3 if k % 4 else None, "w " * (k % 5), "s", "x") for k in range(400)]  # doc_ids and texts repeat
    runs = [mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string, _tie string").repartition(n)).collect() for n in (1, 6)]
    assert len({str(sorted((str(r.doc_id), r.size, r.copies) for r in run)) for run in runs}) == 1
    again = mixing.with_copies(docs.repartition(7)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}
    assert mixing.mix(docs).count() == sum(r.copies for r in got)


def test_mixed_documents_pass_no_sort_or_window(spark):
    rnd = random.Random(4)
    rows = [(k % 300 if k % 9 else None, "w " * rnd.randint(0, 40), rnd.choice(["a", "b", None]), f"x{k % 5}", k, k % 2) for k in range(900)]  # doc_ids repeat
    rows += rows[:20] + [(7, None, "a", None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _tie string, size long, copies int")
    nodes = lambda p: [p, *(x for i in range(p.children().size()) for x in nodes(p.children().apply(i)))]
    for node in nodes(mixing.mix(docs.drop("_tie", "size", "copies"))._jdf.queryExecution().sparkPlan()):
        if "Window" in node.nodeName() or "Sort" in node.nodeName():
            assert not any(c in node.output().toString() for c in ("text", "_doc#")), node.nodeName()
    # every document as often as with_copies has it, its own columns kept
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.with_copies(docs.drop("_tie", "size", "copies")).collect():
        want[r.doc_id, r.text, r.source] += r.copies
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want
    assert {(r["_tie"], r["size"], r["copies"]) for r in out.collect()} <= {r[3:] for r in rows}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_token_blocks_of_any_shape():
    rng = np.random.default_rng(0)
    sources = [rng.integers(0, 65536, 3000), np.zeros(5000, int), rng.integers(0, 3, 4097), np.tile(rng.integers(0, 49408, 7), 600), np.minimum(rng.zipf(1.3, 2500), 65535)]
    for ids in sources:
        for size in (1, 64, 300, 2048):
            table = token_store.new_ids(ids, size)
            blocks = token_store.encode_blocks(ids, size)
            assert (token_store.decode_blocks(blocks, [min(size, len(ids) - i) for i in range(0, len(ids), size)], table) == ids).all()
            # blocks are coded apart from each other: any of them is read alone
            assert (token_store.decode_blocks(blocks[-1:], [len(ids) - (len(blocks) - 1) * size], table) == ids[(len(blocks) - 1) * size :]).all()
    assert token_store.decode_blocks(token_store.encode_blocks(np.empty(0, int)), [], token_store.new_ids(np.empty(0, int))).size == 0


def test_the_coder_adapts():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.4, 40_000), 40_000)  # no order but frequencies
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    data = token_store.write_file(ids, np.array([len(ids)]))
    assert 8 * len(data) / len(ids) < 1.25 * -(p * np.log2(p)).sum()
    again = token_store.write_file(np.tile(rng.integers(0, 49408, 40), 1000), np.array([40_000]))
    assert 8 * len(again) / 40_000 < 0.6


def test_token_store_of_equal_and_missing_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (7, "b a c"), (7, "a"), (7, "b a c"), (7, ""), (8, "x " * 9000), (9, "z")]
    files = lambda n: token_store.read_tokens(token_store.write_tokens(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, file string").repartition(n), token_store.default_tokenizer()))
    got = sorted(files(1).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted(files(5).collect(), key=lambda r: r.start) == got




def test_narrow_tables_code_the_same_blocks():
    # one id alone, blocks of distinct ids, and mixtures; the sum is that of the coder with tables of 32 bits
    ids = np.concatenate([np.arange(9000) ** 2 % 977, np.zeros(2048, int), np.arange(2048 * 3), np.arange(5000) % 13])
    blocks = token_store.encode_blocks(ids)
    assert zlib.crc32(b"".join(blocks)) == 586229022
    assert (token_store.decode_blocks(blocks, [min(2048, len(ids) - i) for i in range(0, len(ids), 2048)], token_store.new_ids(ids)) == ids).all()
    tables = token_store._Lanes(8)
    assert sum(t.nbytes for t in (tables.slot1, tables.slot2, tables.single, tables.some, tables.many)) / 8 <= 4 * 2048 + 2 * (4096 + 256 + 16)
