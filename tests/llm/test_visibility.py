"""Visibility by the cascade, against an independent one over explicit parents."""

import random

import pytest

from quillmer.llm.html_layout import render


@pytest.mark.parametrize("style, body, want", [
    (".tab{display:none}.tab.active{display:block}", '<div class="tab">a</div><div class="tab active">b</div>', "b"),
    ("p{display:none}p{display:block}", "<p>a</p>", "a"),
    ("p{display:block}p{display:none}", "<p>a</p>", ""),
    ("#x{display:block}p.y{display:none}", '<p id=x class=y>a</p><p class=y>b</p>', "a"),
    (".a .b{display:none}", '<div class=a><i><u class=b>x</u></i>y</div><u class=b>z</u>', "y\nz"),
    (".a > .b{display:none}", '<div class=a><i><u class=b>x</u></i><u class=b>y</u></div>', "x"),
    (".a>.b .c{display:none}", '<div class=a><i class=b><u><b class=c>x</b></u></i></div><i class=b><b class=c>y</b></i>', "y"),
    ("p{display:none!important}", '<p style="display:block">a</p><p style="display:block !important">b</p>', "b"),
    ("p{visibility:hidden}b{visibility:visible}", "<p>a<b>b</b></p>", "b"),
    ("p:hover{display:none}a[href]{display:none}p+p{display:none}", "<p>a</p><p>b</p>", "a\n\nb"),
    ("[hidden]{}.s{display:block}u{display:none}", "<div hidden class=s>a</div><div hidden>b</div>", "a"),
    ("div{DISPLAY : None}", "<DIV>a</DIV>b", "b"),
])
def test_pages(style, body, want):
    assert render(f"<style>{style}</style><body>{body}") == want


def test_numbers_of_lists():
    assert render("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert render("<ol reversed><li>a<li>b<li>c</ol><ol reversed start=9><li>d</ol>").split() == "3. a 2. b 1. c 9. d".split()


def brute(elements, rules):
    """Words of (name, parent, tag, classes, inline) elements, parents before children, that show."""

    def fits(e, simple):
        tag, classes = simple
        return tag in ("*", elements[e][2]) and classes <= elements[e][3]

    def matches(e, chain):
        if not fits(e, chain[-1][1]):
            return False
        if len(chain) == 1:
            return True
        up = elements[e][1]
        if chain[-1][0] == ">":
            return up is not None and matches(up, chain[:-1])
        while up is not None:
            if matches(up, chain[:-1]):
                return True
            up = elements[up][1]
        return False

    gone, visible, out = {}, {}, []
    for e, (word, parent, _, _, inline) in enumerate(elements):
        best = {}
        for k, (chain, says) in enumerate(rules):
            if matches(e, chain):
                spec = (sum(len(c) for _, (_, c) in chain), sum(t != "*" for _, (t, _) in chain))
                for prop, value, important in says:
                    best[prop] = max(best.get(prop, ((-1,), "")), ((important, 0, *spec, k), value))
        for prop, value, important in inline:
            best[prop] = max(best.get(prop, ((-1,), "")), ((important, 1), value))
        gone[e] = (parent is not None and gone[parent]) or best.get("display", (0, ""))[1] == "none"
        visible[e] = best["visibility"][1] == "visible" if "visibility" in best else visible[parent] if parent is not None else True
        if visible[e] and not gone[e]:
            out.append(word)
    return out


def test_random_pages_equal_an_independent_cascade():
    r = random.Random(4)
    tags, names = ["div", "section", "span", "b"], ["x", "y", "z"]
    for _ in range(300):
        say = lambda n: [(p, r.choice(["none", "block"] if p == "display" else ["hidden", "visible"]), r.random() < 0.15) for p in r.sample(["display", "visibility"], r.randint(1, n))]
        rules = [([(r.choice(" >"), (r.choice(["*", *tags]), frozenset(r.sample(names, r.choice([0, 1, 1, 2]))))) for _ in range(r.choice([1, 1, 2, 3]))], say(2)) for _ in range(r.randint(1, 6))]
        top = [("", None, "html", frozenset(), []), ("", 0, "body", frozenset(), [])]
        elements = top + [(f"w{k}", r.randrange(k) + 2 if k else 1, r.choice(tags[:2]) if k < 4 else r.choice(tags), frozenset(r.sample(names, r.randint(0, 2))), say(1) if r.random() < 0.1 else []) for k in range(12)]
        css = lambda says: ";".join(f"{p}: {v}{' !important' * i}" for p, v, i in says)
        simple = lambda c: c[0] + "".join("." + x for x in sorted(c[1]))
        style = "".join("".join((way if k else "") + simple(c) for k, (way, c) in enumerate(chain)) + "{" + css(says) + "}" for chain, says in rules)

        def page(e):
            word, _, tag, classes, inline = elements[e]
            inner = "".join(page(k) for k in range(len(elements)) if elements[k][1] == e)
            return f'<{tag} class="{" ".join(sorted(classes))}" style="{css(inline)}">{word} {inner}</{tag}>'

        assert sorted(render(f"<html><head><style>{style}</style></head><body>{page(2)}</body></html>").split()) == sorted(filter(None, brute(elements, rules))), style
