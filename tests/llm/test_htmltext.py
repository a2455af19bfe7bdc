import html
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import htmltext as H
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def article(page):
    """The generated tables' own layout, taken apart by hand."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_generated_pages():
    net = H.trained()
    seqs, labels = H.labelled(200, 99)
    got = np.concatenate(net.label(seqs))
    truth = np.concatenate(labels) > 0
    print("accuracy", (got == truth).mean(), "recall", got[truth].mean(), "precision", truth[got].mean())
    assert (got == truth).mean() > 0.98


def test_gradients():
    rng = np.random.default_rng(0)
    net = H.BiLSTM()
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, mask = H.pad([rng.normal(size=(n, H.DIM)).astype("f4") for n in (3, 5)])
    y = rng.integers(0, 2, mask.shape)
    loss = lambda: float((np.log1p(np.exp(-(2 * y - 1) * net.logits(x, mask))) * mask).sum() / mask.sum())
    g = net.gradients(x, mask, y)
    for k, at in (("wf", (3, 5)), ("wb", (H.DIM + 2, 40)), ("bf", (30,)), ("o", (7,)), ("wb", (1, 80))):
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = loss()
        net.p[k][at] = keep - 1e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 2e-4, k
        net.p[k][at] = keep


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = QUERIES["op7_html_extract"](spark, SF).collect()
    assert len(out) == len(pages)
    wrong = [r.page_id for r in out if r.text != article(pages[r.page_id].html)]
    print(len(wrong), "pages differ of", len(out))
    assert len(wrong) <= 0.01 * len(out)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out)


def test_cases(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "<article><p>a &lt;b&gt; &amp;amp; c\n\t d&nbsp;e<br>f <i>g</i> 1 < 2.</p><script>x<p>y</script><!-- <p>z</p> --></article>"),
        (3, "u", "<article><p>" + "long words here. " * 50000 + "</p></article><footer>bye</footer>"), (4, "u", "<p"), (5, "u", "<!-- open"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    out = H.extract(df).collect()
    assert len(out) == len(rows)
    assert [r.text for r in out if r.page_id in (1, 2, 4, 5)] == ["", "", "", ""]
    three = sorted((r.text for r in out if r.page_id == 3), key=len)
    assert three[0] == "a <b> &amp; c d e f g 1 < 2."
    assert three[1] == ("long words here. " * 50000).strip()
    assert H.extract(df.limit(0)).count() == 0


def test_kept_weights_are_those_of_training():
    """The weights beside the code belong to this recipe, and training gives them again."""
    with np.load(H.WEIGHTS) as kept:
        assert str(kept["recipe"]) == H.recipe()
        again = H.train().p
        assert all(np.allclose(kept[k], again[k], atol=2e-2) for k in again)


def test_unclosed_elements_hide_nothing():
    text = lambda page: [t for _, t, _ in H.blocks(page)]
    assert text("<p>a<svg>zz<p>lost") == ["a", "lost"]
    assert text("<p>a<svg width=1/>b</p><p>c") == ["ab", "c"]
    assert text("<p>a<svg><path d='x'/><text>t</text></svg>b<p>c") == ["ab", "c"]
    for name in ("object", "iframe", "noscript", "template", "textarea", "select", "datalist"):
        assert " ".join(text(f"<p>a</p><{name} x=1><p>b</p>c<p>d")) == "a b c d", name
        assert text(f"<p>a</p><{name} x=1>zz</{name}><p>d") == ["a", "d"], name
    assert text("<article><p>a</p><textarea>typed</textarea><select><option>one<option>two</select><p>b</article>") == ["a", "b"]


def test_every_word_counts():
    words = [f"w{i}" for i in range(100)]
    for at in range(100):
        other = [*words[:at], "elsewhere", *words[at + 1 :]]
        assert H._word_codes[words[at]] == H._word_codes["elsewhere"] or (H.word_vector(other) != H.word_vector(words)).any()


def test_layouts_that_training_has_not_seen():
    """Hand-made pages, labelled by hand: A is text of the article, everything else is not."""
    a = [
        "A river carries stones of all sizes, and in spring the water is strong enough to roll boulders.", "Smaller grains travel as a cloud, and settle where the water slows.",
        "At the mouth of the river they build a delta, which is why deltas are flat.",
    ]
    pages = [
        f"""<body class=home><div id=site-top><a href=/>Blog</a> <a href=/a>About</a> <a href=/c>Contact</a></div><div class=wrapper><div class="col-8 post-content"><h1>How rivers move</h1>
        <p>{a[0]}</p><svg width=3><text>icon</text></svg><p>{a[1]}</p><textarea>write here</textarea><div class=adsbygoogle>Buy cheap boots now, only today!</div><p>{a[2]}</p></div>
        <div class="col-4 sidebar"><h3>Popular</h3><ul><li><a href=1>One post</a></li><li><a href=2>Two posts</a></li></ul></div></div>
        <div id=disqus_thread class=comments><h3>2 comments</h3><p>Great post, thank you!</p><p>I disagree with the second part.</p></div><div class=site-footer>Copyright 2020 Ann Lee.</div></body>""",
        f"""<body><header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav></header><main role=main><article itemscope><h1>How rivers move</h1>
        <section><p>{a[0]}<p>{a[1]}</section><section><p>{a[2]}</section></article></main><aside><h2>More</h2><ul><li><a href=1>One story</a><li><a href=2>Two stories</a></ul></aside><footer><p>All rights reserved.</p></footer></body>""",
        f"""<div class=cookie-notice><p>We use cookies to improve this site.</p><button>Accept</button></div><div id=content><h1>How rivers move</h1><div>{a[0]}</div><div>{a[1]}</div><div>{a[2]}</div></div>
        <form action=/news><label>Mail</label><input name=m><button>Subscribe</button></form><div class=footer>Imprint</div>""",
    ]
    net = H.trained()
    for page in pages:
        seq = H.blocks(page)
        kept = [t for (_, t, _), keep in zip(seq, net.label([H.features(seq)])[0]) if keep]
        assert kept == ["How rivers move", *a]
