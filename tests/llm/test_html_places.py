"""What a marked element is, told by its place: inside the run of an article, or around it."""

import random
from collections import defaultdict

import pytest

from assayframe.llm import html

BODY = "".join(f"<p>Paragraph {i} of the story tells, at some length, what happened; it has commas, and full stops. It goes on for two sentences at least.</p>" for i in range(3))
REST = "".join(f"<p>Closing part {i} tells the rest, in plain words; nothing more follows. It is as long as the other paragraphs are.</p>" for i in range(2))
READERS = "".join(f"<li>Reader {i} says that this is a fine story, really; thanks for it, and please write more of them soon.</li>" for i in range(20))
COOKIES = "We use cookies, and other things, to make this site better for you. By going on, you agree to it. See more."


def page(before="", inside="", end="", behind=""):
    return f"<html><body><nav><a href=a>Home</a></nav>{before}<article><h1>Title of it</h1>{BODY}{inside}{REST}{end}</article>{behind}<footer>All rights, of course.</footer></body></html>"


ARTICLE = html.main_text(page())


def test_the_article_alone():
    blocks = ARTICLE.split("\n\n")
    assert blocks[0] == "Title of it" and len(blocks) == 6 and "Home" not in ARTICLE and "rights" not in ARTICLE


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("<table class='market-share'><tr><td>Acme</td><td>42</td></tr></table>", "Acme\n\n42"),
        ("<ul class='tags-explained'><li>one thing</li><li>other thing</li></ul>", "one thing\n\nother thing"),
        ("<div class='research search-results-of-study'>We found it, in 12 cases.</div>", "We found it, in 12 cases."),
        ("<ol><li><a href=x>First source, 2001</a></li><li><a href=y>Second source</a></li></ol>", "First source, 2001\n\nSecond source"),
        ("<p>Press <button>Go</button> or pick <label>Start</label> to begin with the next step.</p>", "Press Go or pick Start to begin with the next step."),
    ],
)
def test_kept_inside_the_run(markup, text):
    assert html.main_text(page(inside=markup)) == ARTICLE.replace("\n\nClosing part 0", f"\n\n{text}\n\nClosing part 0")


def test_references_at_the_end_stay():
    got = html.main_text(page(end="<h2>References</h2><ol><li><a href=x>First source, 2001</a></li><li><a href=y>Second source</a></li></ol>"))
    assert got == f"{ARTICLE}\n\nReferences\n\nFirst source, 2001\n\nSecond source"


AROUND = [
    "<div class='ad-slot'>Buy now, cheap things for all. Really.</div>",
    "<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Post</a></div>",
    "<div class='newsletter-box'>Get our letters, every week. Sign up, it is free.</div>",
    f"<ol class='commentlist'>{READERS}</ol>",
    f"<section class='reader-responses'>{READERS}</section>",
    f"<div class='alert'>{COOKIES}</div>",
    f"<div class='rail'>{COOKIES}</div>",
    "<div><label>Name</label><button>Send</button></div>",
]


@pytest.mark.parametrize("markup", AROUND)
def test_left_out_around_the_run(markup):
    assert html.main_text(page(behind=markup)) == ARTICLE
    assert html.main_text(page(before=markup)) == ARTICLE
    assert html.main_text(page(end=markup)) == ARTICLE


@pytest.mark.parametrize("markup", AROUND[:3])
def test_adverts_are_left_out_inside_the_run(markup):
    assert html.main_text(page(inside=markup)) == ARTICLE


def test_text_behind_the_container_needs_its_path():
    part = lambda x: f"<div class='part'>{x}</div>"
    unlike = f"<div class='more'>{REST.replace('Closing', 'Other')}</div>"
    got = html.main_text(f"<body><div>{part(BODY * 4)}</div>{unlike}</body>")
    assert "Paragraph 2" in got and "Other" not in got


def test_path_scores_by_brute_force():
    """Ratios of each path, the mean of itself and its container's, and their geometric mean, from the definition."""
    rng = random.Random(3)
    paths = [("html", "body", "article", "p"), ("html", "body", "article", "p", "b"), ("html", "body", "article", "ul", "li"), ("html", "body", "nav", "a"), ("html", "body"), ("html", "body", "article", "ul.x", "li", "a")]
    for _ in range(20):
        nodes = [(rng.choice(paths), n := rng.randrange(1, 400), rng.randrange(0, 9), rng.choice([0, 0, n])) for _ in range(rng.randrange(1, 40))]
        held = defaultdict(list)
        for path, *rest in nodes:
            held[path].append(rest)
        container = {}
        for path in held:
            at = list(path)
            while at and at[-1].split(".")[0] not in html.BLOCK:
                at.pop()
            container[path] = tuple(at[:-1])
        length = {p: max(0, sum(x[0] for x in v) - 2 * sum(x[2] for x in v)) / len(v) for p, v in held.items()}
        marks = {p: (1 + sum(x[1] for x in v)) / len(v) for p, v in held.items()}
        got = html.path_scores(nodes)
        assert set(got) == set(held)
        for p in held:
            near = [q for q in held if container[q] == container[p]]
            mean = lambda r: (r[p] + sum(r[q] for q in near) / len(near)) / 2  # noqa: B023, E731
            assert abs(got[p] - (mean(length) * mean(marks)) ** 0.5) < 1e-9
