"""Blocks below many elements keep their own tag and nearest classes."""

from tessera.llm import html_text


def test_deep_blocks_keep_their_innermost_elements():
    page = '<div class="content">' + "<div>" * 70 + '<div class="comment"><section class="ad"><li>deep words</li></section></div>'
    (text, _, ancestors), *_ = html_text.leaf_blocks(page)
    features = html_text.block_features(text, 0.0, ancestors)
    assert {"tag=li", "inmost=ad", "class=talk", "class=ad", "class=main", "in=section"} <= set(features) and "shallow" not in features
    stack = [("div", ("main",))] + [("div", ())] * 70 + [("div", ("talk",)), ("section", ("ad",)), ("li", ())]
    assert features == html_text.block_features(text, 0.0, tuple(stack))
