"""op6: accuracy on rows that aren't learnt from, and odd texts."""

import zlib

import numpy as np

from riskloom.llm import langid


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    net = langid.learn(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% 3"), (None, "the of and with for"), (5, "a" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == "en"
    seen = langid.identify(docs, net).withColumn("held_out", langid.held_out("doc_id")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in seen)
    held = [r for r in seen if r.held_out and len(r.text) > 50]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in seen)


def test_nothing_labelled(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.learn(docs) is None
    assert [r.lang_pred for r in langid.identify(docs, None).collect()] == ["und", "und"]
    assert langid.keep_identified(docs, None).count() == 0
    assert langid.learn(docs.limit(0)) is None


def test_windows_cover_whole_texts():
    own = [b"", b"abc", bytes(range(1, 256)) * 5]
    x, first, inside = langid.cover(own)
    assert first.tolist() == [0, 1, 2] and inside[0] == 0 and inside[1] == 3
    step = langid.WINDOW - langid.OVERLAP
    again = x[2][:step].tobytes() + b"".join(w[:step].tobytes() for w in x[3:])
    assert again.rstrip(b"\0").startswith(own[2])


def test_kept_by_languages_learnt(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, None), (3, "12 34"), (4, "")], "doc_id long, text string")
    assert langid.keep_identified(docs.limit(0), None).count() == 0
    net = langid.train([b"one two three " * 20, b"uno dos tres " * 20], ["en", "es"])
    assert langid.least_score(net) == 0.3
    net.languages = [str(i) for i in range(100)]
    assert langid.least_score(net) == 0.02
    assert langid.keep_identified(docs, langid.train([b"some words " * 9, b"otras cosas " * 9], ["en", "es"])).columns == docs.columns


def test_gradient_against_differences():
    net = langid.train([b"alpha beta " * 9, b"gamma delta " * 9], ["a", "b"])
    net.embed, net.filters, net.out = net.embed.astype(float), [w.astype(float) for w in net.filters], net.out.astype(float)
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 256, (3, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(3), y]).mean()
    grads = langid._gradients(net, x, y)
    for w, g in ((net.filters[0], grads[1]), (net.out, grads[-2])):
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 12)]:
            kept, h = w[at], 1e-6
            w[at] = kept + h
            up = loss()
            w[at] = kept - h
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * h) - g[at]) < 1e-4


def test_forward_pass_against_loops():
    net = langid.train([b"alpha beta " * 9, b"gamma delta " * 9], ["a", "b"])
    text = b"gamma beta, and more of the same kind of words " * 9
    total, weights = np.zeros(2), 0
    step = langid.WINDOW - langid.OVERLAP
    for start in range(0, max(1, len(text) - langid.OVERLAP), step):
        part = text[start : start + langid.WINDOW]
        codes = list(part) + [0] * (langid.WINDOW - len(part))
        pooled = []
        for w, b in zip(net.filters, net.bias):
            width = len(w) // langid.EMBEDDING
            for f in range(langid.FILTERS):
                best = max(sum(float(net.embed[codes[i + j]] @ w[j * langid.EMBEDDING : (j + 1) * langid.EMBEDDING, f]) for j in range(width)) for i in range(langid.WINDOW - width + 1))
                pooled.append(max(0.0, best + float(b[f])))
        z = np.array(pooled) @ net.out + net.shift
        e = np.exp(z - z.max())
        total += e / e.sum() * len(part)
        weights += len(part)
    assert np.allclose(langid.predict(net, [text])[0], total / weights, atol=1e-4)
