"""Regions judged by density, dives inside articles, and the line blocks against a plain version."""

import random
import time

import pytest

from learngraph.llm import html_text

P = "A paragraph that belongs to the story as much as any other of its sections does, told at some length."
STORY = "".join(f"<p>{P}</p>" for _ in range(5))
TEXT = "\n".join([P] * 5)
MENU = "<nav><ul><li><a href=x>Home</a><li><a href=x>News</a></ul></nav>"
FOOT = "<footer>Imprint and so on</footer>"


@pytest.mark.parametrize(
    "page",
    [
        f'{MENU}<div class="layout sidebar-right">{STORY}</div>{FOOT}',
        f'{MENU}<div class="newsletter-archive">{STORY}</div>{FOOT}',
        f'<body><form id="aspnetForm">{MENU}<article>{STORY}</article>{FOOT}</form>',
        f'<body><form id="aspnetForm">{MENU}<div>{STORY}</div><input><button>Go</button>{FOOT}</form>',
        f'<div class="header"><div class="menu-page">{MENU}<main>{STORY}</main></div></div>',
        f'<div id="comments-on-law">{STORY}</div>{FOOT}',
        f"<aside>{STORY}</aside>",
        f'<article>{STORY}</article><div class="sidebar">{STORY}{STORY}</div>',
        f'<div>{STORY}</div><div class="comments">{STORY}{STORY}{STORY}</div>',
        f"<div>{STORY}</div><section class='comment-list'><p>{P}</p></section><form><p>{P}</p></form>",
        f'<article>{STORY}<div class="comments"><p>{P}</p></div><div class="ad-slot">{P}</div></article>',
        f'<article>{STORY}<div class="comments" style="display:none"><p>{P}</p></div></article>',
    ],
)
def test_density_has_the_last_word_on_names(page):
    assert html_text.main_text(page) == TEXT


def test_sections_of_an_article_with_telling_names_stay():
    for names in ('id="comments-on-law"', 'class="reply"', 'class="newsletter-history"', 'class="the-social-contract"'):
        assert html_text.main_text(f"<article>{STORY}<section {names}><p>{P}</p></section></article>") == f"{TEXT}\n{P}"


def test_runs_of_links_inside_an_article_are_dives():
    links = "".join(f"<li><a href=x>Another piece number {i}</a>" for i in range(3))
    assert html_text.main_text(f"<article>{STORY}<h3>More of this</h3><ul>{links}</ul><p>{P}</p><p>End.</p></article>") == f"{TEXT}\n{P}\nEnd."
    few = "<ul><li><a href=x>One source</a><li><a href=x>Other source</a></ul>"
    assert html_text.main_text(f"<article>{STORY}{few}<p>{P}</p></article>") == f"{TEXT}\nOne source\nOther source\n{P}"
    assert html_text.main_text(f"<article>{STORY}<ul>{links}<li>No link here</ul></article>").endswith("No link here")


@pytest.mark.parametrize("part", ["<div class=ad><article>a", "<nav><article>", "<article><div class=reply>a", "<form><div class=menu>", "<div class=x-comments-y>b", "<menu>"])
def test_nested_regions_are_read_in_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * (300_000 // len(part)))
    assert time.process_time() - began < 20


def plain_spans(found):
    n, w = len(found), [max(0, len(t) - 2 * linked) for t, linked, _, _ in found]
    total = [sum(w[k : k + 3]) for k in range(n)]
    limit = min(86.0, 0.5 * max(total, default=0))
    keep, k = [False] * n, 0
    while k < n:
        if total[k] > limit and w[k]:
            while k < n and sum(w[k : k + 3]):
                keep[k] = True
                k += 1
        k += 1
    home = [c for _, _, _, c in found]
    text = lambda inside: sum(w[k] for k in range(n) if keep[k] and (home[k] >= 0) == inside)
    if text(True) > text(False):
        keep = [keep[k] and home[k] >= 0 for k in range(n)]
    some = {home[k] for k in range(n) if keep[k] and home[k] >= 0}
    keep = [keep[k] or home[k] in some for k in range(n)]
    for k in range(n):
        run = [j for j in range(k, n) if all(home[i] == home[k] >= 0 and w[i] == 0 for i in range(k, j + 1))]
        if len(run) >= 3 and not (k and home[k - 1] == home[k] and w[k - 1] == 0):
            for j in run:
                keep[j] = False
            if k and found[k - 1][2] and home[k - 1] == home[k]:
                keep[k - 1] = False
    for k in range(1, n):
        keep[k] = keep[k] or (home[k - 1] < 0 and home[k] < 0 and keep[k - 1] and found[k][1] == 0)
    for k in reversed(range(n - 1)):
        keep[k] = keep[k] or (home[k + 1] < 0 and home[k] < 0 and keep[k + 1] and (found[k][1] == 0 or found[k][2]))
    return [k for k in range(n) if keep[k]]


def test_line_blocks_equal_a_plain_version():
    rng = random.Random(6)
    for _ in range(800):
        found, container = [], -1
        for _ in range(rng.randrange(0, 25)):
            if rng.random() < 0.2:
                container = rng.choice([-1, -1, 1, 2])
            size = rng.choice([3, 8, 20, 40, 90, 200])
            found.append(("x" * size, rng.choice([0, 0, 0, size, size // 2, size // 3]), rng.random() < 0.15, container))
        assert [k for a, b in html_text.spans(found) for k in range(a, b)] == plain_spans(found)
