import random

from litloom.llm import language_id as L

WORDS = {"en": "the of and to in that with which from this have were", "de": "der die und nicht eine mit auf für über schön straße", "fr": "le la les des est dans pour avec être à où ça", "es": "el los una con para más niño está pero como qué"}


def rows(n=240):
    r = random.Random(7)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(6, 60))), lang))
    return out


def test_held_out_accuracy_and_cases(spark):
    data = rows()
    extra = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "fr"), (None, "der die und nicht", None), (1003, "the of and " * 9000, None), (1003, "the of and " * 9000, None)]
    docs = spark.createDataFrame([(a, b, c, 0.5) for a, b, c in data + extra], "doc_id long, text string, lang string, score double")
    model = L.fit(docs, ~L.is_held_out(5, 0), per_class=60, landmarks=40)
    got = L.predict(docs, model).collect()
    assert len(got) == len(data) + len(extra) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert sum(by[i] == lang for i, _, lang in data) >= 0.97 * len(data)
    assert by[1000] == by[1001] == by[1002] == "und" and by[None] == "de" and by[1003] == "en"
    kept = L.keep_identified(docs, model, 0.4)
    assert kept.columns == docs.columns and 1000 not in {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id = 1003").count() == 2


def test_kernel_is_presence_overlap():
    texts = ["abab cd", "abcd", "xyz", "ab"]
    m = L.train(texts, ["a", "b", "a", "b"], landmarks=4)
    sets = [set(L.presence(t, m.lut).tolist()) for t in texts]
    k = m.kernel(texts)
    for i, s in enumerate(sets):
        for j, o in enumerate(sets):
            assert abs(k[i, j] - len(s & o) / (len(s) * len(o)) ** 0.5) < 1e-6


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(docs, ~L.is_held_out(5, 0)) is None
    assert L.predict(docs, None).first().lang_pred == "und"
    assert L.predict(docs.limit(0), None).count() == 0


def scripts(n=40):
    """Texts of six scripts with many letters, two languages in each."""
    r = random.Random(3)
    out = []
    for at, size in ((0x61, 26), (0x430, 32), (0x3B1, 17), (0x628, 20), (0x4E00, 3000), (0x20000, 900)):
        for side in (0, 1):
            words = ["".join(chr(at + r.randrange(size)) for _ in range(r.randint(2, 5))) for _ in range(30)]
            out += [(" ".join(r.choice(words) for _ in range(r.randint(8, 30))), f"{at:x}-{side}") for _ in range(n)]
    r.shuffle(out)
    return out


def test_letters_beyond_the_table(monkeypatch):
    data = scripts()
    learn, rest = data[:360], data[360:]
    kernels = []
    for most in (L.MOST_GRAMS, 0):
        monkeypatch.setattr(L, "MOST_GRAMS", most)
        m = L.train(*map(list, zip(*learn)))
        assert m.dense == (most > 0)
        kernels.append(m.kernel([t for t, _ in rest]))
        lang, score = L.judge(m, [t for t, _ in rest])
        assert lang == [y for _, y in rest] and min(score) >= 0.4
        assert L.judge(m, ["ⴰⴱⴲ ⴳⴴ"]) == (["und"], [0.0])
    assert abs(kernels[0] - kernels[1]).max() < 1e-6
    grams = lambda t: {g for w in t.split() for k in (1, 2, 3) for g in (f" {w} "[i : i + k] for i in range(len(w) + 3 - k))} - {" "} | {a[-1] + " " + b[0] for a, b in zip(t.split(), t.split()[1:])}
    assert all(len(L.presence(t, m.lut)) == len(grams(t)) for t, _ in data)


def test_each_of_many_languages_has_landmarks():
    r = random.Random(5)
    vocabulary = {f"l{c:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7))) for _ in range(12)] for c in range(220)}
    draw = lambda c: " ".join(r.choice(vocabulary[c]) for _ in range(25))
    learn = [(draw(c), c) for c in vocabulary for _ in range(10)]
    m = L.train(*map(list, zip(*learn)))
    assert m.size == 8 * 220
    lang, _ = L.judge(m, [draw(c) for c in vocabulary])
    assert sum(a == c for a, c in zip(lang, vocabulary)) >= 0.97 * 220


def test_query_folds_and_predictions(spark, tmp_path):
    """The registered query on a folder: folds, and each prediction from plain sets of n-grams."""
    import zlib

    data = rows(160)
    spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = L.op10_string_kernel_language(spark, str(tmp_path)).collect()
    assert len(got) == len(data) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by, truth = {r.doc_id: r for r in got}, {i: lang for i, _, lang in data}
    assert sum(by[i].lang_pred == truth[i] for i in truth if by[i].held_out) >= 0.97 * sum(r.held_out for r in got)
    learnt, labels = L.sample(docs.where(~L.is_held_out(5, 0)).selectExpr("doc_id", "text", "lang as label"), L.PER_CLASS)
    assert len(learnt) == sum(not r.held_out for r in got)
    model = L.train(learnt, labels)
    grams = lambda t: {g for k in (1, 2, 3) for g in (f" {t} "[i : i + k] for i in range(len(t) + 3 - k))} - {" "}
    queues = {}
    for t, y in zip(learnt, labels):
        queues.setdefault(y, []).append(t)
    marks = [q[k] for k in range(len(learnt)) for _, q in sorted(queues.items()) if k < len(q)][: L.LANDMARKS]
    for i, t, _ in data[::5]:
        own = grams(" ".join(t.lower().split()))
        k = [len(own & (o := grams(" ".join(m.lower().split())))) / (len(own) * len(o)) ** 0.5 for m in marks]
        z = [sum(a * b for a, b in zip(k, column)) * L.SHARPNESS for column in model.coef.T.tolist()]
        p = [2.718281828459045 ** (x - max(z)) for x in z]
        assert model.classes[z.index(max(z))] == by[i].lang_pred and abs(max(p) / sum(p) - by[i].score) < 1e-3


def test_no_language_is_left_out_and_bytes_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (1 if i % 3 else 400), f"l{i % 40:02}") for i in range(400)], "doc_id long, text string, label string")
    texts, labels = L.sample(docs, 100, most_rows=80)
    assert len(set(labels)) == 40 and max(map(labels.count, labels)) <= L.LEAST_EACH
    texts, labels = L.sample(docs, 100, most_bytes=2000)
    assert sum(map(len, texts)) <= 2000 and len(texts) > 100
