"""Rendered pages stay in proportion to their markup, and show what a screen shows."""

import time

import pytest

from splicelake.llm.html_text import extract


def text(source):
    return extract(source)[1]


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<table><tr><td>" + "w" * (40 * n) + "</td><td>x</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * n + "</table>",
        lambda n: "<ul><li>x" * n,
        lambda n: "<table>" + "<tr><td rowspan=0>a</td></tr>" * n + "</table>",
        lambda n: "<table>" + "<tr><td rowspan=900>a</td></tr>" * n + "</table>",
        lambda n: "<table><tr>" + "<td>c</td>" * 900 + "</tr>" + "<tr><td colspan=899></td><td>x</td></tr>" * n + "</table>",
        lambda n: "<table><tr><td>left</td><td>a<br>b<br>" * (n // 4) + "end",
        lambda n: "<table><tr><td>" * n + "end",
        lambda n: "<blockquote>q<dl><dd>d" * n,
        lambda n: "<details><summary>s" * n + "end",
        lambda n: "<style>" + "@media print{.a{display:none}}" * n + "</style>" + "<p class=a>shown" * n,
    ],
)
def test_output_and_time_are_linear(page):
    sizes, times = [], []
    for n in (1000, 4000):
        source = page(n)
        began = time.process_time()
        out = text(source)
        times.append(time.process_time() - began)
        sizes.append(len(out))
        assert len(out) <= 330 * len(source) + 1000
    assert sizes[1] <= 6 * sizes[0] + 1000
    assert times[1] <= 12 * times[0] + 1.0


def test_no_text_is_lost_without_layout():
    wide = "<table><tr><td>" + "w" * 3000 + "</td><td>after</td></tr>" + "".join(f"<tr><td>a{i}</td><td>b{i}</td></tr>" for i in range(300)) + "</table>"
    got = text(wide)
    assert "w" * 3000 + "  after" in got and all(f"a{i}" in got and f"b{i}" in got for i in range(300))
    assert len(got) < 3 * len(wide)
    deep = "<table><tr><td>in" * 30 + " end" + "</td></tr></table>" * 30 + "after"
    assert text(deep).split() == ["in"] * 30 + ["end", "after"]
    spans = "<table>" + "".join(f"<tr><td rowspan=0>r{i}</td></tr>" for i in range(1500)) + "</table>"
    assert text(spans).split() == [f"r{i}" for i in range(1500)]


def test_columns_stay_aligned():
    got = text("<table><tr><td>one</td><td>x</td></tr><tr><td>three</td><td>y</td></tr></table>").split("\n")
    assert got == ["one    x", "three  y"]


@pytest.mark.parametrize(
    "sheet, shown",
    [
        ("@media print{.a{display:none}}", True),
        ("@media screen{.a{display:none}}", False),
        ("@media print, screen {.a{display:none}}", False),
        ("@media only all{.b{color:red} .a{display:none}}", False),
        ("@media (max-width: 600px){.a{display:none}}", True),
        ("@media screen and (max-width: 600px){.a{display:none}}", True),
        ("@import 'x.css'; .a{display:none}", False),
        ("@media print{@media screen{.a{display:none}}}", True),
        ("@supports (display: grid){.a{display:none}}", False),
        ("@font-face{font-family:x;src:y} .a{display:none}", False),
        ("@keyframes k{from{display:none}} .b{display:none}", True),
        ("/* .a{display:none} */ .a{color:red}", True),
    ],
)
def test_at_rules(sheet, shown):
    assert ("shown" in text(f"<style>{sheet}</style><p class=a>shown</p><p>rest")) == shown


def test_details():
    closed = "<p>a<details><summary>head</summary><p>gone<details open><summary>deep</summary>x</details></details><p>b"
    assert text(closed).split() == ["a", "head", "b"]
    assert text(closed.replace("<details>", "<details open>", 1)).split() == ["a", "head", "gone", "deep", "x", "b"]
    assert text("<details>never closed").split() == [] and text("<div hidden><details><summary>s</summary></details></div>z") == "z"
