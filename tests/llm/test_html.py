"""HTML extraction against a plain version of its rules, and without the marks that it takes as priors."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd

from loomline.llm import html_text as H

LONG = "It was the end of the day and the man had to be at the house that was on the hill, so he went with her there. " * 3
LONG = LONG.strip()


class Plain(HTMLParser):
    """Blocks of well-formed pages of div, p, h2, a and b, as (tag, text, linked characters, container's number)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.stack, self.text, self.linked, self.link = [], ["body"], "", "", False
        self.articles, self.inside = 0, []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            self.found.append((self.stack[-1], text, len("".join(self.linked.split())), self.inside[0] if self.inside else 0))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag != "b":
            self.cut()
            self.stack.append(tag)
            if tag == "article":
                self.articles += 1
                self.inside.append(self.articles)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag != "b":
            self.cut()
            self.stack.pop()
            if tag == "article":
                self.inside.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += data if self.link else ""


def plain_density(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return max(sum(w in set(v.split()) for w in words) for v in H.STOP_WORDS.values()) / len(words) if words else 0.0


def plain_labels(found, marked):
    def links(b):
        return b[2] > 0.5 * len("".join(b[1].split()))

    prose = [b for b in found if len(b[1]) >= 70 and not links(b)]
    known = sum(len(b[1]) for b in prose if plain_density(b[1]) >= 0.3) >= 0.25 * sum(len(b[1]) for b in prose)
    first = []
    for b in found:
        n, d = len(b[1]), plain_density(b[1])
        if links(b) or not marked and n <= 200 and b[1].lower().startswith(("©", "copyright ")):
            first.append("bad")
        elif n < 70:
            first.append("short")
        elif d >= 0.3 or not known:
            first.append("good" if n > 200 or marked else "near")
        else:
            first.append("near" if d >= 0.1 or marked else "bad")
    ends = "good" if marked else "bad"
    out = []
    for i, x in enumerate(first):
        if x in ("good", "bad"):
            out.append(x)
            continue
        decided = [(-1, ends, "")] + [(j, y, found[j][0]) for j, y in enumerate(first) if y in ("good", "bad")] + [(len(first), ends, "")]
        j, low, low_tag = max(d for d in decided if d[0] < i)
        k, high, high_tag = min(d for d in decided if d[0] > i)
        if low == high:
            out.append(low)
        elif marked or x == "near" or found[i][0] == "h2" and high == "good" or i - j != k - i:
            if marked or x == "near" or found[i][0] == "h2" and high == "good":
                out.append("good")
            else:
                out.append(low if i - j < k - i else high)
        else:
            out.append("good" if (low_tag if low == "good" else high_tag) == found[i][0] else "bad")
    if "good" not in out:
        out = ["good" if x in ("near", "short") else "bad" for x in first]
    return out


def plain_text(page):
    found = Plain(page).found
    labels = plain_labels(found, False)

    def good(part):
        return sum(len(b[1]) for b, x in zip(found, labels, strict=True) if x == "good" and b in part)

    articles = {}
    for b in found:
        if b[3]:
            articles.setdefault(b[3], []).append(b)
    if articles:
        best = max(articles.values(), key=lambda p: (good(p), sum(len(b[1]) for b in p)))
        rest = [b for b in found if not b[3]]
        marked = good(best) >= 0.3 * (good(best) + good(rest))
        found = best if marked else rest
        labels = plain_labels(found, marked)
    return " ".join(b[1] for b, x in zip(found, labels, strict=True) if x == "good")


def test_equals_the_plain_version():
    r = random.Random(8)
    stop = "the of and to in was that it his with".split()
    other = "house river glass winter paper morning street candle letter garden".split()

    def words(n, share):
        return " ".join(r.choice(stop if r.random() < share else other) + str(r.randrange(10**6)) * (r.random() < 0.02) for _ in range(n))

    def block(i):
        tag = r.choice(["p", "p", "p", "div", "h2"])
        kind = r.random()
        if kind < 0.2:
            return f"<{tag}>" + " ".join(f"<a href='{j}'>{words(2, 0.2)} {i}.{j}</a>" for j in range(r.randint(1, 6))) + f"</{tag}>"
        text = words(r.choice([1, 2, 5, 15, 25, 60]), r.choice([0.0, 0.15, 0.25, 0.5]))
        return f"<{tag}>{'&copy; ' * (kind > 0.95)}{text} &amp; <b>{i}</b></{tag}>"

    decided = 0
    for n in range(600):
        parts = [block(i) for i in range(r.randint(1, 14))]
        for _ in range(r.choice([0, 0, 1, 2])):
            a = r.randrange(len(parts))
            parts[a] = f"<article>{parts[a]}{''.join(block(100 * n + j) for j in range(r.randint(0, 5)))}</article>"
        page = "<html><body>" + "".join(parts) + "</body></html>"
        assert H.main_text(page) == plain_text(page), page
        decided += H.main_text(page) != " ".join(b[1] for b in Plain(page).found)
    assert decided > 300


def test_pages_without_marks_keep_their_words():
    """Neither article nor semantic tags, classes or ids: density and neighbours alone find the text."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    of, kept, more, rules = 0, 0, 0, 0
    for page in pages:
        want = Counter(H.main_text(page).split())
        bare = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main)\b", r"<\1div", re.sub(r' (?:class|id)="[^"]*"', "", page))
        got = Counter(H.main_text(bare).split())
        every = Counter(" ".join(b.text for b in H.blocks(bare)).split())
        of, kept, more = of + want.total(), kept + (want & got).total(), more + (got - want).total()
        rules += every != got
    assert kept >= 0.95 * of and more <= 0.02 * of and rules == len(pages)


def test_marks_are_priors():
    p = f"<p>{LONG}</p>"
    teaser = "<article><h2>Read on</h2><p>Another story of the week.</p></article>"
    links = "<ul>" + "<li><a href=x>Another page of the site</a></li>" * 5 + "</ul>"
    for page, want in [
        (f"<article>{p}</article>{teaser}", LONG),
        (f"{teaser}<article>{p}{p}</article>{teaser}", f"{LONG} {LONG}"),
        # an article of few words doesn't hide what the page is about
        (f"<div>{p}{p}{p}{p}</div>{links}<article><p>{LONG[:75]}</p></article>", " ".join([LONG] * 4)),
        (f"<article>{p}<div class='share-price'><p>The price of a share was 5.</p></div><div class='header-text'>{p}</div></article>", f"{LONG} The price of a share was 5. {LONG}"),
        (f"<article>{p}{links}{p}</article>", f"{LONG} {LONG}"),
        (f"<article>{p}<video src=a>{p}</article>", f"{LONG} {LONG}"),
        (f"<article>{p}<object data=a><p>Instead of a film.</p></object></article>", f"{LONG} Instead of a film."),
        (f"<article>{p}<svg><path d=''>{p}</article>", f"{LONG} {LONG}"),
        (f"<main><nav>{links}</nav>{p}</main><footer>The end of the page.</footer>", LONG),
        (f"<article>{p}<pre>{'x = f(y) ' * 30}</pre></article>", f"{LONG} {('x = f(y) ' * 30).strip()}"),
        ("<article><p>Only a line.</p></article><div>Other</div>", "Only a line."),
        (f"<div>{p}</div><div>&copy; 2020 A house of the city</div>", LONG),
        ("<p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()),
    ]:
        assert H.main_text(page) == want, page[:400]


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, None, f"<p>{LONG}</p>"), (1, "u", None), (1, "u", None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")
    got = sorted(map(tuple, H.extract(df).collect()), key=repr)
    assert got == sorted([(None, None, LONG, len(LONG)), (1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0)], key=repr)
