"""op4 over layouts written by hand, with their text written out; op10 where nothing may be learnt."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tessella.llm import html_text, ngram, store

P = "The committee published its long awaited report on the future of the regional railways, and the authors ask for more trains on weekdays and fewer delays."
LAYOUTS = {
    "paragraphs alone": (f"<html><body><p>{P}</p><p>{P} Again.</p></body></html>", [P, f"{P} Again."]),
    "one open paragraph": ("<p>just text", ["just text"]),
    "no tags": ("bare text", ["bare text"]),
    "nested divisions": (f"<div><div><div>{P}</div></div></div>", [P]),
    "table, links by line": (f"<html><body><table><tr><td><a href='/'>Home</a><br><a href='/a'>About us</a></td><td><h1>Railways</h1><p>{P}</p></td></tr></table></body></html>", ["Railways", P]),
    "table, links in a list": (f"<html><body><table><tr><td><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></td><td><p>{P}</p><p>Second.</p></td></tr></table></body></html>", [P, "Second."]),
    "fallback in the article": (f"<article><h1>Railways</h1><p>{P}</p><noscript><p>The chart shows the delays of the last ten years by region.</p></noscript></article>", ["Railways", P, "The chart shows the delays of the last ten years by region."]),
    "divisions without names": (f"<div><a href='/'>Home</a> <a href='/b'>Blog</a></div><div><h1>Railways</h1><p>{P}</p><p>{P}</p></div><div>&copy; 2024 Example</div>", ["Railways", P, P]),
    "main with list and aside": (f"<body><nav><a href='/'>Home</a></nav><main><h2>Part</h2><p>{P}</p><ul><li>one thing</li><li>another</li></ul></main><aside>Related stories</aside><footer>© 2024 Example</footer></body>", ["Part", P, "one thing", "another"]),
    "reader comments": (f"<body><header><a href='/'>Site</a></header><div id='content'><h1>Title here</h1><p>{P}</p></div><div id='comments'><h3>Comments</h3><div class='comment'><p>Nice article, thank you.</p></div></div></body>", ["Title here", P]),
    "notice and form": (f"<body><div class='cookie notice'><p>We use cookies to improve this site.</p></div><article><h1>Railways</h1><p>{P}</p></article><form class='subscribe'><label>Your mail</label><input><button>Send</button></form></body>", ["Railways", P]),
}


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout(model, name):
    page, want = LAYOUTS[name]
    assert html_text.extract(model, [page]) == ["\n".join(want)]


def test_held_out_rows_only(spark):
    ids = [r.id for r in spark.range(200).filter((F.crc32(F.col("id").cast("string")) % 7) == 2).limit(3).collect()]
    docs = spark.createDataFrame(list(zip(ids, ["one", "one two two", None], strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram.score_documents(docs).collect()}
    assert len(got) == 3 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in got.values())
    # with nothing counted each token has (0 + 1) / (0 + 1 * (0 + 1))
    assert all(r.base_score == r.score == r.score_2 == 0 for r in got.values())
    assert [got[i].n_tokens for i in ids] == [2, 4, 1]


def test_one_word(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("same same same").alias("text"))
    got = ngram.score_documents(docs).collect()
    assert len(got) == 60 and all(math.isfinite(r.score) and r.n_known == 4 for r in got)
    assert all(r.score > r.base_score for r in got)


def test_ngram_files_do_not_grow_with_the_input(spark, monkeypatch):
    """Hundreds of shards are a bounded number of files; a word in half of all places is dealt to several packs; scores stay what they are."""
    kept: list[str] = []
    monkeypatch.setattr(ngram, "remove", lambda root: kept.append(root.removeprefix("file:")))
    rows = [(k, " ".join(f"the w{(k * j) % 701}" for j in range(1, 60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r for r in ngram.score_documents(docs, shard_tokens=n).collect()} for n in (1_000_000, 100))
    files = [sum(len(names) for _, _, names in os.walk(root)) for root in kept]
    assert files[0] == 2 and ngram.PACKS < files[1] <= 2 * ngram.PACKS
    packs = [ngram.Trie(kept[1], int(name)) for name in os.listdir(f"{kept[1]}/2")]
    assert sum(p.words == 1 for p in packs) > 5 and sum(len(p.rows) for p in packs) > 2 * len(packs)
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (many[i].n_tokens, many[i].n_known, many[i].train_tokens) and abs(r.base_score - many[i].base_score) < 1e-6
        assert abs(r.score_2 - many[i].score_2) < 0.02 * r.n_tokens and abs(r.score - many[i].score) < 0.02 * r.n_tokens
    for root in kept:
        store.remove(root)
