import gzip

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import articles, markdown


def test_corpus_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.MD").write_text("---\ntitle: 'A b'\nauthor: Q\nauthor_id: q1\n---\n# Hello\n\nSome *prose* here.\n")
    (tmp_path / "a.markdown").write_text("Plain words.")
    (tmp_path / "skip.rst").write_text("no")
    rows = {r.document_id: r for r in markdown.load_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"sub/b.MD", "a.markdown"}
    r = rows["sub/b.MD"]
    assert r.metadata["title"] == "A b" and r.author_id == "q1" and r.clean_text == "Hello\n\nSome prose here." and r.genre == "blog" and len(r.file_hash) == 64
    (tmp_path / "m.txt").write_text("Subject: x\n\nThree words here\n")
    mail = markdown.load_email(spark, str(tmp_path), "gmail").collect()
    assert [(m.document_id, m.genre, m.clean_text) for m in mail] == [("gmail/m.txt", "gmail_email", "Three words here")]
    assert {r.document_id for r in markdown.load_foreign(spark, str(tmp_path)).collect()} == {"negative/sub/b.MD", "negative/a.markdown", "negative/m.txt"}
    (tmp_path / "empty.md").write_text("---\ntitle: x\n---\n")
    with pytest.raises(ValueError, match="no .txt file"):
        markdown.load_email(spark, str(tmp_path / "sub"))
    raw = spark.createDataFrame([("---\ntags: [a, b]\nn: 3\n---\nText",), ("no block",), (None,), ("---\n---\nx",)], "t string")
    assert [r.m for r in raw.select(markdown.front_matter(raw.t).alias("m")).collect()] == [{"tags": "['a', 'b']", "n": "3"}, {}, None, {}]
    assert [r.m for r in raw.select(markdown.body(raw.t).alias("m")).collect()] == ["Text", "no block", None, "x"]
    for bad, why in (("---\n- a\n---\n", "mapping"), ("---\na: [\n---\n", "pars|expected")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(bad,)], "t string").select(markdown.front_matter(F.col("t"))).collect()
    dirty = spark.createDataFrame([("---\nauthor: -\nsource_type: email\n---\nx",)], "t string")
    assert dirty.select(markdown.front_matter(F.col("t"), strict=False).alias("m")).first().m == {"author": "-", "source_type": "email"}
    with pytest.raises(Exception, match="no usable prose"):
        markdown.load_markdown(spark, str(tmp_path)).collect()


def test_html_and_markdown_articles(spark):
    page = "<html><nav><p>menu</p></nav><article class='post'><p>One <b>bold</b> &amp; two.</p><pre><p>x</p></pre><p>Three<br>four</p></article><p>out</p></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id bigint, html string")
    assert {r.page_id: r.text for r in articles.html_prose(df, "post").collect()} == {1: "One bold & two.\n\nThree four", 2: None, 3: ""}
    odd = "<div id=main><p>One $x$ <span class='katex'>y</span><p>Two<ul><li><p>In list</p></ul></div><p>after</p><blockquote><div id=main><p>quoted</p></div></blockquote>"
    assert articles.paragraphs_of(odd, "main") == ["Two", "In list"] or articles.paragraphs_of(odd, "main") == ["In list"]
    assert articles.paragraphs_of("<main><p>a<br/>b</p><p> </p></main>", "main") == ["a b"] and articles.paragraphs_of("<p>x</p>", "main") == []
    with pytest.raises(ValueError, match="selector"):
        articles.html_prose(df, "")
    md = spark.createDataFrame([("Short one.\n\n" + "word " * 12 + "\n\nUpdated " + "word " * 12,)], "t string")
    assert md.select(articles.markdown_article(md.t).alias("x")).first().x.count("word") == 12


def test_mbox(spark):
    box = b"From a@b Mon\nMessage-ID: <1@x>\nContent-Type: text/plain\n\nHello there friend.\n\nFrom a@b Mon\nMessage-ID: <2@x>\n\nOther.\n"
    assert articles.mbox_message(gzip.compress(box), "<1@x>").strip() == "Hello there friend."
    with pytest.raises(ValueError):
        articles.mbox_message(box, "<9@x>")
    df = spark.createDataFrame([(1, bytearray(box), "<1@x>")], "box_id bigint, content binary, message_id string")
    assert articles.mbox_messages(df).first().text == "Hello there friend."


def test_json_lists(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"document_ids": ["a", "b", "a"]}')
    sealed = articles.sealed_ids(spark, str(tmp_path / "s.json"))
    assert sorted(r.document_id for r in sealed.collect()) == ["a", "b"]
    groups = spark.createDataFrame([("a", "g"), ("b", "h"), ("c", "g"), ("d", "i")], "document_id string, group_id string")
    assert sorted(r.document_id for r in articles.sealed_groups(sealed, groups).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="is not there"):
        articles.sealed_groups(sealed, groups.where("document_id <> 'b'"))
