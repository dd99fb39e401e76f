import random
import time

import numpy as np
import pytest

from corpusmill.llm import abuse, markup

PLAIN = [
    "Equality is spelt == there and the x is 3 < 5 <= 8.", "A List<String> or a Map<Key, block> is accepted.", "It computes a * b * c, then |x| -> y --> z.", "R&D and Q&A; x_1 and y_2 at 50%.",
    "One run costs $5 and the full one $70.", "Call it with *args and **kwargs, read file_name_v2 and _init again.", r"The path C:\new\temp\begin holds it.", "Wait ~5 seconds, then x^2 grows.",
    'They wrote "teh" [sic] and {curly} names; see [3] and (4).', "Ticket #42 and C# port.", "Tilde paths such as ~/data and a_b_c stay.", "", "  \n ",
]
MARKED = [
    "a <b>x</b>", "x<br>y", "<!-- c --> x", "R&amp;D", "&#39;", "&nbsp;x", "# Title\nx", "Title\n=====\n", "Title\n---\n", "```\ncode\n```", "use `x` now", "**x** y", "_once_ and", "~~x~~", "[a](b)", "![a](b.png)", "x[^1]",
    "> quoted", "- item\n- item", "1. item", "| a |\n|---|\n| b |", "[[link|x]]", "{{Infobox a\n| b = c\n}}", '{| class="w"\n|-\n|}', "== H ==\nx", "'''b'''", r"\section{A} x", r"As \emph{x} shows", r"\begin{itemize}", r"$\alpha_{x}$", r"\[ x \]", "~~~sh\nx\n~~~", "** sub",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert markup.constructs(text) == [] and markup.clean(text) == text


@pytest.mark.parametrize("text", MARKED)
def test_constructs_are_seen(text):
    assert markup.constructs(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h2>A <i>b</i></h2><p>x</p><ul><li>1<li>2</ul>", "## A b\n\nx\n\n- 1\n- 2"), ("<pre><code>a &lt; b</code></pre>", "```\na < b\n```"), ("x<script>var a;</script>y", "xy"),
        ("<TABLE><TR><TD>a<TD>b</TR><TR><TD>c<TD>1</TABLE>", "a | b\nc | 1"), ("T\n===\n\n* a\n+ b\n1. c", "# T\n\n- a\n- b\n1. c"), ("```py\n# <b>k</b>\n```", "```\n# <b>k</b>\n```"),
        ("| a | b |\n|---|:-:|\n| c | 1 |", "a | b\nc | 1"), ("see [x](y) and ![p](q)", "see x and p"), ("== H ==\n* a\n** b\n# c\n[[p|q]] '''r'''", "## H\n- a\n  - b\n- c\nq r"),
        ("\\section{S}\\label{l}\n\\begin{itemize}\n\\item a\n\\end{itemize}\nthe \\emph{b}~\\cite{c} is $x_1$", "# S\n\n- a\n\nthe b is $x_1$"), ("&lt;p&gt;a&lt;/p&gt; &amp;lt;b&amp;gt;", "a\n <b>"),
        ("a **b** `c*d*e` ~~f~~ _g_", "a b c*d*e f g"), (None, None), ("<p>unclosed <b>bold", "unclosed bold"),
    ],
)
def test_clean(text, want):
    assert markup.clean(text) == want


def test_broken_markup_never_fails():
    rng = random.Random(0)
    bits = ["<p>", "</p>", "<b", ">", "&amp", ";", "```", "[[", "]]", "{{", "}}", "\\begin{x}", "$", "*", "**", "|", "\n", "word ", "<!--", "{|", "=="]
    for _ in range(300):
        t = "".join(rng.choice(bits) for _ in range(40))
        markup.clean(t)
        markup.subtrees(t)


def test_site_templates_are_removed(spark):
    menu = "<div class='m'><ul><li>Home page of this site</li><li>All the other pages</li></ul></div>"
    pages = [("site", f"p{k}", f"{menu}<p>The own text of page number {k} is here</p>") for k in range(30)] + [("other", "x", f"{menu}<p>once</p>"), ("site", "n", None), ("site", "e", "")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "source string, id string, text string, clean string")
    got = {(r.source, r.id): r.clean for r in markup.converted(df, ["source", "id"], "source", "text").collect()}
    assert got["site", "p3"] == "The own text of page number 3 is here"
    assert "Home page" in got["other", "x"] and got["site", "n"] is None and got["site", "e"] == ""
    assert markup.converted(df.limit(0), ["source", "id"], "source", "text").count() == 0


@pytest.mark.parametrize("unit", ["<div>", "<pre>", "<!-- ", "<p>text ", "<li>item", "</div>", "<h2>", "\\[ ", "\\\\[ ", "<script>", "````\n", "<b><i>", "\\begin{verbatim}"])
def test_time_is_in_proportion_to_the_text(unit):
    """Ten times the text that is never closed takes about ten times as long."""
    text = unit * (400_000 // len(unit))

    def took(t):
        begin = time.process_time()
        markup.subtrees(t)
        markup.clean(t)
        return time.process_time() - begin

    assert took(text) < 30 * max(0.1, took(text[: len(text) // 10]))


def test_implied_ends():
    text = "<ul><li>the first item of this list<li>the second item of this list</ul><p>a paragraph with enough text<p>another one with enough text<div>x</div>"
    spans = {text[a:b] for _, a, b in markup.subtrees(text)}
    assert "<li>the first item of this list" in spans and "<p>a paragraph with enough text" in spans and "<p>another one with enough text" in spans


def test_templates_beyond_the_broadcast(spark):
    pages = [("site", f"p{k}", f"<div><p>the same banner on every page</p></div><p>own {k}</p>") for k in range(20)] + [(None, "n", "<p>x</p>")]
    df = spark.createDataFrame(pages, "source string, id string, text string")
    got = [sorted((str(r.source), r.id, r.kinds, r.clean) for r in markup.converted(df, ["source", "id"], "source", "text", bound).collect()) for bound in (100, 0)]
    assert got[0] == got[1] and ("site", "p7", ["site_template", "html_tag"], "own 7") in got[0]


# --- abusive content -----------------------------------------------------------------------------

BAD = [
    "You are a useless moron and everybody here despises you.", "Shut up, you s​t​u​p​i​d idiot.", "Get lost, you d.i.p.s.h.i.t!", "nobody wants you here, you h4lfw17", "Only a l***r like you would write this.", "You are stuрid and so is your code.",
    "YOU ARE A WORTHLESS LOSER.", "I know where you live and I will make you pay.", "All Exampleans are vermin and should be driven out.", "We should wipe out every last one of them.", "Never trust Exampleans, they are thieves by birth.",
    "Tu es un abruti fini.", "Halt die Fresse, du Vollidiot.", "Cállate, imbécil de mierda.", "Les Exemples sont des parasites, il faut les chasser.", "Die Beispieler sind Abschaum und gehören vertrieben.", "Los Ejemplos son ratas y hay que echarlos.",
    "They had rough sex on the floor all night.", "send me naaaaked pics now", "Click here for free xxx videos.", "ты идиот",
]
GOOD = [
    "Use the kill flag to stop zombie child processes before the job starts.", 'The word list holds "idiot", "porn" and "vermin" as samples.', "Reviewers mark a post as abusive if it calls somebody a moron.", "A bloody long stub again, but it survived.",
    "Slave replicas follow the master heartbeat.", "The garbage handle is collected and the trash folder is emptied.", "The sex column of the demographic table is coded 0 and 1.", "Strip the naked record down to its bare fields.", "Set the limit to 5 if your queries are mostly cached.",
    "Die Prüfsumme ändert sich nur, wenn sich der Text ändert.", "Les résultats déjà vus sont écartés.", "Rat and cockroach sightings are stored in the pest field.", "The medical policy covers breast cancer.", "",
]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    filler = [f"The {a} of the {b} is cut into {n} parts." for a in ("index", "cache", "term") for b in ("page", "query") for n in range(9)]
    docs = []
    for k in range(240):
        parts = [rng.choice(filler) for _ in range(3)] + [rng.choice(GOOD)] + ([BAD[k // 2 % len(BAD)]] if k % 2 else [])
        docs.append((k, " ".join(parts), bool(k % 2)))
    return docs


def test_documents_are_told_apart(spark, corpus):
    df = spark.createDataFrame([(k, t, "s") for k, t, _ in corpus] + [(900, None, None), (901, "", None), (902, " ", None), (0, corpus[0][1], "s")], "doc_id bigint, text string, score string")
    got = {r.doc_id: r.score for r in abuse.score_documents(df).collect()}
    assert len(got) == len(corpus) + 3 and max(got[900], got[901], got[902]) < 0.5
    flagged = {k for k, s in got.items() if s >= abuse.THRESHOLD}
    truth = {k for k, _, bad in corpus if bad}
    assert len(flagged & truth) >= 0.95 * len(truth) and len(flagged - truth) <= 0.02 * len(truth)
    assert abuse.score_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, word", [("d i p s h i t", "dipshit"), ("n4k3d", "naked"), ("l***r", "loser"), ("moroooon", "moron"), ("mоrоn", "moron"), ("i​d​i​o​t", "idiot"), ("ＭＯＲＯＮ", "moron"), ("a h.a.l.f.w.i.t", "halfwit"), ("s****d", "stupid")])
def test_disguises(text, word):
    assert word in abuse.reveal(abuse.fold(text)).split()


def test_label_model_learns_and_discounts():
    vectors = np.array([0, 1, 2, 3, 1 << abuse.NAMES.index("meta"), 1 | 1 << abuse.NAMES.index("meta")])
    counts = np.array([5000, 40, 40, 60, 300, 5])
    model = abuse.LabelModel(vectors, counts)
    q = dict(zip(vectors.tolist(), model.posterior(vectors)))
    assert q[3] > 0.9 and q[1] > 0.5 and q[0] < 0.01 and q[1 << abuse.NAMES.index("meta")] < 0.01
    assert model.correlated.shape == (len(abuse.VOTERS),) * 2 and (model.weights <= 1).all()
