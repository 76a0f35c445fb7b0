"""Operators on texts: small cases, invariants and the awkward rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import mail, mailtext, mixing, packing, sentences, subjects, tokens

PROSE = "The train left early. Dr. Olsen waved from platform 3. Nobody asked why! Was it late? It cost ca. 4 coins.\n\n"


def corpus():
    names = "Olsen Berg Lind Holm Dahl Ness Vik Moe".split()
    things = "train letter garden window ledger harbour basket lantern".split()
    rng, out = random.Random(0), []
    for i in range(400):
        a, b, c = rng.choice(names), rng.choice(things), rng.choice(things)
        own = [f"The {b} left early.", f"Dr. {a} waved from the {c}.", f"Nobody saw the {b}!", f"Was the {c} late?", f"It cost ca. {i} coins near the {c}.", f"“Is it done?” asked {a} softly.", f"The {b} opened at 6 a.m. sharp.", f"Then the {c} closed."]
        rng.shuffle(own)
        out.append(" ".join(own[:4]) + "\n\n" + " ".join(own[4:]))
    return out


def test_sentences(spark):
    model = sentences.EventModel.fit(corpus())
    t = "Dr. Berg waved from the garden. Was the train late? It cost ca. 14 coins near the harbour.\nThen the letter closed.\n\nA heading here\n\n- one item\n- two items\n\n“Is it done?” asked Lind softly. The window opened at 6 a.m. sharp."
    got = [t[a:b] for a, b in sentences.spans(t, model)]
    assert got == ["Dr. Berg waved from the garden.", "Was the train late?", "It cost ca. 14 coins near the harbour.", "Then the letter closed.", "A heading here", "- one item", "- two items", "“Is it done?” asked Lind softly.", "The window opened at 6 a.m. sharp."]
    assert sentences.spans("", model) == [] and sentences.spans(" \n\n ", model) == []
    assert [b - a for a, b in sentences.spans("今天下雨。明天呢？好", model)] == [5, 4, 1]
    rows = [("a", PROSE, 1), ("b", None, 2), (None, "x", 3), ("c", "", 4), ("d", "word " * 50_000, 5), ("e", "no end", 6)]
    df = spark.createDataFrame(rows, "document_id string, text string, start_char int")
    got = defaultdict(list)
    for r in sentences.sentences(df).collect():
        got[r.document_id].append((r.start_char, r.end_char))
    assert set(got) == {"a", "d", "e"} and len(got["d"]) == 1 and got["e"] == [(0, 6)]
    assert sentences.sentences(df.where("document_id = 'zz'")).count() == 0



def test_sentences_in_scripts_without_marks(spark):
    thai = "วันนี้ฝนตกหนัก เขาไปตลาดแต่เช้า รถไฟมาถึงช้า เด็กเล่นในสวน แม่ทำอาหารเย็น เราดูเรือที่ท่า".split()
    khmer = "ថ្ងៃនេះមានភ្លៀង។ គាត់ទៅផ្សារពីព្រឹក។ រថភ្លើងមកយឺត។ ក្មេងលេងក្នុងសួន។".split()
    rng = random.Random(1)
    for words in (thai, khmer):
        docs = ["\n\n".join(" ".join(rng.sample(words, 4)) for _ in range(3)) for _ in range(40)]
        assert all(len(s[2]) >= 2 for s in sentences.places(docs[0], 0, len(docs[0])))
        own, other = sentences.EventModel.fit(docs), sentences.EventModel.fit(corpus()[:20])
        assert [docs[0][a:b] for a, b in sentences.spans(docs[0], own)] == docs[0].split()
        assert " ".join(docs[0][a:b] for a, b in sentences.spans(docs[0], other)).split() == docs[0].split()
    rows = [("th", " ".join(thai)), ("km", " ".join(khmer)), ("en", PROSE)]
    got = Counter(r.document_id for r in sentences.sentences(spark.createDataFrame(rows, "document_id string, text string")).collect())
    assert got["th"] >= 1 and got["km"] == 4 and got["en"] >= 4


def test_sentences_of_texts_without_any_mark():
    model = sentences.EventModel.fit(corpus())
    parts = ["the train left early", "nobody saw the letter", "the window closed", "then the ledger closed", "dr berg waved from the harbour", "nobody saw the basket", "the lantern left early", "then the train closed", "the garden left early", "nobody saw the harbour"]
    parts[2] = "then the window closed"
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences.spans(text, model)] == parts
    assert len(sentences.spans("a heading of six words here", model)) == 1  # too short to tell that its marks are missing
    marked = ". ".join(x.capitalize() for x in parts) + "."
    assert len(sentences.spans(marked, model)) == len(parts)
    rng = random.Random(2)
    han = lambda: rng.choice("我们 他们 老师 孩子 火车 医生".split()) + rng.choice("昨天去了 今天修好了 早上看见了 晚上打开了".split()) + rng.choice("学校 花园 图书馆 市场 窗户".split())
    thai = "วันนี้ฝนตกหนัก เขาไปตลาดแต่เช้า รถไฟมาถึงช้า เด็กเล่นในสวน แม่ทำอาหารเย็น เราดูเรือที่ท่า".split()
    for docs, parts in ((["。".join(han() for _ in range(5)) + "。" for _ in range(300)], [han() for _ in range(12)]), (["\n\n".join(rng.sample(thai, 3)) for _ in range(100)], [rng.choice(thai) for _ in range(10)])):
        model, text = sentences.EventModel.fit(docs), "".join(parts)
        assert [text[a:b] for a, b in sentences.spans(text, model)] == parts


def test_the_model_counts_all_texts_where_they_lie(spark):
    texts = [*corpus(), "", "no end", "今天下雨。明天呢？好"]
    here = sentences.EventModel.fit(texts)
    there = sentences.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for name in ("prior", "left", "start", "run", "share", "seen", "ending", "opening", "edges_left"):
        a, b = getattr(here, name), getattr(there, name)
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-6 for k in a), name
    assert here.names == there.names


MAIL = """---
author: Ann Moe
---

From: Ann Moe <ann@x.example>
Subject: plan

Hi Bo,

We met Sent Jones by the quay. Bo wrote: it is fine, and I agree.
- first point
> earlier words here
> go on

An answer between.

Best regards,
Ann

--
Ann Moe
Reader, Texts
Tel. 0123 555 777

This message and its attachments are meant only for the addressee named by Y.

On 3 May 2031, at 10:12, Bo <bo@x.example>
wrote:
> old text
"""


def test_mail_lines(spark):
    lines, kinds = mailtext.mark(MAIL, "Ann Moe")
    assert [x for x, k in zip(lines, kinds) if k] == ["Hi Bo,", "We met Sent Jones by the quay. Bo wrote: it is fine, and I agree.", "- first point", "An answer between."]
    assert not any(mailtext.mark("---------- Forwarded message ---------\nFrom: a\nSent: b\nTo: c\n\nHello", None)[1])
    earlier = "The first paragraph of the earlier message that is certainly long enough to be found again, as it goes on and on about the harbour, the boats and the weather of last week."
    rows = [
        ("m1", earlier, "t", 1, "Bo", "bo"), ("m2", "Thanks for this.\n\n" + "\n".join(earlier[i : i + 40] for i in range(0, len(earlier), 40)), "t", 2, "Ann", "ann"),
        ("m3", None, "t", 3, "Ann", "ann"), ("m4", "", "t", 4, None, None), ("m1", earlier, "t", 1, "Bo", "bo"), ("p", "prose", "t", 1, "x", "x"), (None, "Hi", "t", 1, "x", "x"),
    ] + [(f"s{i}", f"Body number {i} says something.\n\nkeep calm and read on", None, 5, "Cy", "cy") for i in range(4)]
    df = spark.createDataFrame([(*r[:4], r[3], r[4], r[5], "blog" if r[0] == "p" else "work_email", None, 1) for r in rows], "document_id string, raw_markdown string, root_document_id string, written_at int, loaded_at int, author string, author_id string, genre string, source_type string, line_no int")
    got = defaultdict(list)
    for r in mail.new_lines(df).orderBy("document_id", "line_no").collect():
        got[r.document_id].append(r.line)
    assert got["m1"] == [earlier] and got["m2"] == ["Thanks for this."] and "p" not in got
    assert got["s1"] == ["Body number 1 says something."]
    assert mail.new_lines(df.where("document_id = 'none'")).count() == 0


def test_copies_of_a_mail_keep_their_paragraphs(spark):
    body = ["The quay was closed on Monday because of the storm.", "We moved the boats into the inner harbour by hand.", "Nobody was hurt and nothing was lost in the end.", "The crane will be repaired before the summer starts.", "Bring your own ropes when you come next week."]
    copies = [(f"c{i}", "\n\n".join(body)) for i in range(4)] + [(f"g{i}", "\n\n".join([f"Hi {n},", *body])) for i, n in enumerate(("Bo", "Cy", "Di", "Ed"))]
    ended = [(f"e{i}", f"Letter {i} is about lamp number {i}.\n\nkeep calm and read on") for i in range(3)]
    rows = [(d, raw, None, 1, 1, "Ann", "ann", "work_email", None) for d, raw in copies + ended]
    df = spark.createDataFrame(rows, "document_id string, raw_markdown string, root_document_id string, written_at int, loaded_at int, author string, author_id string, genre string, source_type string")
    got = defaultdict(list)
    for r in mail.new_lines(df).orderBy("document_id", "line_no").collect():
        got[r.document_id].append(r.line)
    assert all(got[f"c{i}"] == body and got[f"g{i}"][1:] == body for i in range(4))
    assert all(len(got[f"e{i}"]) == 1 for i in range(3))  # what ends different letters still goes


def test_automaton_against_brute_force():
    rng = random.Random(6)
    held = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    a = mail.Automaton()
    for i, t in enumerate(held):
        a.add(t, i)
    for before in (1, 2, 3, 4):
        for _ in range(20):
            t = held[0][10:30] + "".join(rng.choice("abc") for _ in range(40)) + held[2][5:25] + held[3][:9]
            got = set()
            for s, e in a.inherited(t, before, 8):
                got |= set(range(s, e))
            assert got == {k for i in range(len(t) - 7) if any(t[i : i + 8] in h for h in held[:before]) for k in range(i, i + 8)}


def test_a_longer_match_of_a_later_message_hides_none_of_an_earlier_one():
    rng = random.Random(9)
    words = "".join(rng.choice("abcdefghij") for _ in range(180))
    a = mail.Automaton()
    a.add("x" * 5 + words[:150], 0)
    a.add("y" * 5 + words, 1)  # the later message holds 30 characters more
    assert a.inherited(words, 1, 120) == [(0, 150)] and a.inherited(words, 2, 120) == [(0, 180)] and a.inherited(words, 0, 120) == []


def test_long_messages_go_in_pieces(spark):
    rng = random.Random(3)
    earlier = "\n".join("".join(rng.choice("abcdefghijklmnop ") for _ in range(60)) for _ in range(60))
    rows = [("m1", earlier, "t", 1), ("m2", "New words here.\n\n" + earlier, "t", 2), ("m3", "Others.\n\n" + earlier[600:2400], "t", 3)]
    df = spark.createDataFrame([(*r, r[3], "A", "a", "work_email", None) for r in rows], "document_id string, raw_markdown string, root_document_id string, written_at int, loaded_at int, author string, author_id string, genre string, source_type string")
    old = mail.PIECE, mail.SOURCE_CHARS, mail.READERS
    try:
        for mail.PIECE, mail.SOURCE_CHARS, mail.READERS in ((old), (500, 1000, 1)):
            got = defaultdict(list)
            for r in mail.new_lines(df).orderBy("document_id", "line_no").collect():
                got[r.document_id].append(r.line)
            assert got["m2"] == ["New words here."] and got["m3"][0] == "Others." and len(got["m3"]) <= 3 and len(got["m1"]) == 60
    finally:
        mail.PIECE, mail.SOURCE_CHARS, mail.READERS = old


def test_endings_are_learned_without_word_lists(spark):
    names = "Ann Bo Cy Di Ed Flo".split()
    rows = [(f"{n}{k}", f"{n} tells of {w} number {k} and of its owner.\n\nHochachtungsvollst\n{n}\nSent by carrier snail", n) for n in names for k, w in enumerate(("lamps", "boats"))]
    df = spark.createDataFrame([(d, raw, None, 1, 1, n, n.lower(), "work_email", None) for d, raw, n in rows], "document_id string, raw_markdown string, root_document_id string, written_at int, loaded_at int, author string, author_id string, genre string, source_type string")
    got = defaultdict(list)
    for r in mail.new_lines(df, lists=False).orderBy("document_id", "line_no").collect():
        got[r.document_id].append(r.line)
    assert len(got) == 12 and all(len(v) == 1 and " tells of " in v[0] for v in got.values())
    text = {r.document_id: r.clean_text for r in mail.new_text(mail.new_lines(df, lists=False)).collect()}
    assert text["Ann0"] == "Ann tells of lamps number 0 and of its owner."


def test_packing(spark):
    sizes = [700, 300, 650, 350, 400, 400, 200, 999, 1, 1000]
    bins = packing.pack(sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(10)) and all(sum(sizes[i] for i in b) <= 1000 for b in bins) and len(bins) == 5
    rows = [(i, 1 + (i * 37) % 600) for i in range(500)] + [(900, 5000), (901, None), (None, 5), (902, 0), (903, 512)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    packs = spark.createDataFrame([("s", 512), ("m", 2048), ("bad", 0), (None, 9)], "pack string, capacity_tokens int")
    got = packing.pack_texts(df, packs, group=100).collect()
    for name, cap in (("s", 512), ("m", 2048)):
        own = [r for r in got if r.pack == name]
        held, docs = Counter(), defaultdict(list)
        for r in own:
            held[r.bin] += r.tokens
            docs[r.doc_id].append((r.piece, r.first_token, r.tokens))
        assert max(held.values()) <= cap and set(docs) == {i for i, n in rows if i is not None and n}
        for i, n in rows:
            if i is not None and n:
                p = sorted(docs[i])
                assert sum(x[2] for x in p) == n and (len(p) == 1) == (n <= cap) and all(x[1] + x[2] == y[1] for x, y in zip(p, p[1:]))
    assert {r.pack for r in got} == {"s", "m"}
    assert packing.fill_report(packing.pack_texts(df, packs), packs).count() == 2
    assert packing.pack_texts(df.where("doc_id < 0"), packs).count() == 0


def test_mixing(spark):
    rows = [(i, " Big " if i % 2 else "big", 10 + i % 90) for i in range(3000)] + [(5000 + i, "small", 50) for i in range(40)] + [(9000, None, 5), (9001, "big", None), (None, "big", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").selectExpr("doc_id", "lower(trim(source)) AS source", "tokens")
    targets = spark.createDataFrame([("m", "BIG", 0.75, 1), ("m", "small", 0.25, 3), ("n", "big", 0.5, 2), ("n", "absent", 0.5, 2)], "mix string, source string, target_share double, max_repeats int")
    old = mixing.BUCKET, mixing.FAN
    mixing.BUCKET, mixing.FAN = 100, 4  # so that the tree has several levels
    copies, report = mixing.mix_sources(df, targets)
    mixing.BUCKET, mixing.FAN = old
    r = {(x.mix, x.source): x for x in report.collect()}
    assert abs(r["m", "big"].reached_share - 0.75) < 0.01 and r["m", "small"].most_copies == 3 and r["m", "big"].most_copies == 1
    assert r["n", "absent"].texts == 0 and r["n", "big"].reached_share == 1.0
    assert copies.where("copies < 1 or copies > 3").count() == 0
    assert mixing.mix_sources(df.where("doc_id < 0"), targets)[0].count() == 0
    import random

    total = [0.0] * 4
    for s in range(400):
        out = mixing.settle([5, 10, 20, 40], [0.5, 0.25, 0.75, 0.3], random.Random(s))
        assert abs(sum(a * b for a, b in zip(out, [5, 10, 20, 40])) - (2.5 + 2.5 + 15 + 12)) < 1e-6 and sum(0 < p < 1 for p in out) <= 1
        total = [a + b for a, b in zip(total, out)]
    assert all(abs(a / 400 - b) < 0.08 for a, b in zip(total, [0.5, 0.25, 0.75, 0.3]))


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", "A "), (2, "", "a"), (3, None, "a"), (4, "  \n", "a"), (None, "x", "a"), (5, "<|endoftext|>", None)], "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in tokens.sized(df).collect()}
    assert got[1] == ("a", 2) and set(got) == {1, 5} and got[5][1] > 1


def test_subjects_on_held_out_documents(spark):
    import random

    rng = random.Random(7)
    lexicon = {"law": "judge court verdict appeal witness clause".split(), "music": "violin chord melody tempo choir drum".split(), "Sport": "goal striker league coach referee sprint".split()}
    filler = "the a of near under with quiet letter garden window morning slowly opened carried".split()

    def sentence(s):
        words = [rng.choice(filler) for _ in range(7)]
        if s:
            for _ in range(2):
                words[rng.randrange(7)] = rng.choice(lexicon[s])
        return " ".join(words).capitalize() + "."

    docs, labels, truth = [], [], {}
    for i in range(400):
        own = rng.sample(list(lexicon), rng.choice([1, 1, 2]))
        parts = [own[0]] * 5 + ([own[1]] * 5 if len(own) > 1 else [])
        rng.shuffle(parts)
        docs.append((i, " ".join(sentence(s) for s in [*parts, None]), "en", "x"))
        truth[i] = set(own)
        if i % 4 == 0:
            labels.append((i, (own[0].upper() + " ") if i % 40 else "music", "z"))
    docs += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "Quiet garden near the window.", "en", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, share string")
    l = spark.createDataFrame([*labels, (None, "law", "z"), (3, None, "z"), (5, "nonsense", "z")], "doc_id bigint, subject string, text string")
    s = spark.createDataFrame([(x, "d") for x in lexicon], "subject string, description string")
    found = subjects.document_subjects(d, l, s)
    got = defaultdict(set)
    for r in found.collect():
        got[r.doc_id].add(r.subject)
    held = [i for i in truth if i % 4]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9 and not got[1000] and not got[1001] and not got[1002]
    assert subjects.composition(found, d).count() == 3
    assert subjects.document_subjects(d.where("doc_id < 0"), l, s).count() == 0
    assert subjects.document_subjects(d, l.where("doc_id < 0"), s.where("subject = 'x'")).count() == 0


def test_leaves_are_split_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(subjects, "FIT_ROWS", 100)
    monkeypatch.setattr(subjects, "TOGETHER", 150)
    rng = np.random.default_rng(1)
    terms = [sorted(rng.choice(np.arange(20) + 20 * (i % 3), 6, replace=False).tolist()) for i in range(900)] + [[]]
    rows = [(i, "en", 1, np.array(t, np.uint16).tobytes(), np.array([len(t)] if t else [], np.uint16).tobytes()) for i, t in enumerate(terms)]
    bags = spark.createDataFrame(rows, "doc_id bigint, lang string, sentences int, terms binary, sizes binary")
    m = subjects.Model(["a"], np.ones(60, np.float32), {"en": 0}, np.zeros((60, 1)), np.ones(60, np.float32), np.arange(60) != 59)
    x, many = subjects.clusters(bags, m, 901)
    assert many.sum() == 900 and len(x) <= 200
    whole = sum(subjects.Bags.of(b).vectors(m).sum(0) for b in bags.toArrow().to_batches())
    assert np.allclose(x.sum(0), whole, rtol=1e-4)
    leaf = subjects.bisect(x, 3, 4, np.random.default_rng(5), many)
    for i in range(3):
        own = x[leaf == i].sum(0).reshape(-1)[:59]
        assert own.max() > 0 and max(own[:20].sum(), own[20:40].sum(), own[40:].sum()) / own.sum() > 0.95
    one, each = subjects.clusters(bags.limit(50), m, 50)
    assert len(one) == 50 and (each == 1).all()


@pytest.mark.parametrize("text", ["", "   ", "One. Two! Three?", "Dr. A. Bee came at 5 p.m. sharp.", "x" * 10_000])
def test_rough_sentences_cover(text):
    spans = subjects.sentence_spans(text)
    assert "".join(text[a:b] for a, b in spans).strip() == text.strip()
