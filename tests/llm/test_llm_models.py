import hashlib
import random

from helpers_llm import DOCS, docs_of, words
from tracehound.llm.chat import PARTS, conversation_digests, format_turns, read_back
from tracehound.llm.html_text import extract, labelled_pages, main_text, parse, train
from tracehound.llm.toxicity import toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    bad = ["idiotish", "moronic", "scumbag", "losers"]
    texts, labels = [], []
    for i in range(900):
        t = words(rng.randint(20, 120), i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, 1, int(toxic)))
    texts += ["", None]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs_of(spark, texts), known).collect()}
    held = [i for i in range(900) if got[i].held_out]
    right = sum(got[i].predicted == labels[i][2] for i in held)
    assert right / len(held) > 0.9 and 250 < len(held) < 350
    assert got[900].predicted == got[901].predicted == 0
    assert toxicity(docs_of(spark, ["a"]), known.limit(0)).collect()[0].score == 0.0
    assert toxicity(spark.createDataFrame([], DOCS), known).count() == 0


def test_html_blocks_and_layouts(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>One  two\nthree <b>four<br><p>Five &#x41;</p>"
        "<div class='comments'><p>First! A comment of a reader.</p></div></article><aside><p>Other news.</p></aside><footer>&copy; x</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>" + "word " * 50_000, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract(rows).collect()}
    assert got[1].text == "A & B\nOne two three four\nFive A"
    assert got[2].text == got[3].text == "" and got[4].n_chars in (0, 249_999)
    assert extract(rows.limit(0)).count() == 0


def test_html_end_tags_find_deep_elements():
    def said(source):
        return [text for _, text in parse(source).runs], sum(parse(source).linked)

    for shapes in (3, 12, 400):
        for silent in (
            "<svg>" + "<path d='M 0/'/>" * shapes + "</svg>",
            "<svg>" + "<path>" * shapes + "</svg>",
            "<svg><style/>" + "<g><circle r=1 /></g>" * shapes + "</svg>",
            "<svg/>" * shapes,
            "<select>" + "<option>o" * shapes + "</select>",
            "<select>" + "<optgroup><option>o" * shapes + "</select>",
        ):
            assert said(f"<body><article>before {silent} after</article>") == (["before after"], 0)
        assert said("<p><a href=/x>" + "<b>" * shapes + "in</a> out</p>") == (["in out"], 2)
    assert said("<p><span/>a</span> b") == (["a b"], 0)  # no slash outside svg closes
    assert said("<p>" + "<option>o " * 20 + "</p><p>a") == (["a"], 0)


def test_html_marginals_on_unseen_layouts():
    model, unseen = train(labelled_pages(200)), labelled_pages(60, 77)
    right = [text == "\n".join(t for node, t in p.runs if p.label[node]) for p, text in zip(unseen, main_text(unseen, model), strict=True)]
    assert sum(right) / len(right) > 0.8
    assert parse("<p>a<p>b</div></p>c<").runs[-1][1].startswith("c")


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|><|im_start|>assistant ok", "<\\|x <\\\\|y <", None, "", "é𝄞\n\n"]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("assistant",)] + [(None, None, "us\\er\n<|", "x"), (2, 0, None, "y" * 100_000), (2, 0, None, "y" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", f"cast(array(named_struct('kind','text','text',text,'ref',null,'width',null,'height',null,'seconds',null,'pages',null)) as {PARTS}) as parts"
    )
    formatted = format_turns(turns)
    for r in formatted.collect():
        assert len(read_back(r.formatted)) == 1
    got = {r.conv_id: r for r in conversation_digests(formatted).collect()}
    said = "".join(f"assistant\n{t or ''}\n" for t in texts)
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t or "" for t in texts).encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"us\\er\n<|\nx\n").hexdigest()
    assert got[2].n_turns == 2
    assert conversation_digests(formatted.limit(0)).count() == 0


def test_parts_are_visited_in_order(spark):
    row = spark.sql(
        f"select 1L conv_id, 0L turn, 'user' role, cast(array(named_struct('kind','text','text','<|image|> see ','ref',null,'width',null,'height',null,'seconds',null,'pages',null),"
        f"named_struct('kind','image','text',null,'ref','a.png','width',56,'height',29,'seconds',null,'pages',null),"
        f"named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.0,'pages',null)) as {PARTS}) parts"
    )
    r = format_turns(row).collect()[0]
    assert "<\\|image|> see <|image|><|audio|>" in r.formatted
    assert [(a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 50)]
    assert r.expanded_tokens == 54 and r.loss_start is None
