import time
import unicodedata

import pytest

from stratalens.llm import leakage

ITEM = "An engineer pins 12 tools at revision 340 and observes nine plugins whose hooks fail before the well known board stamps anything."
AUTO = leakage.automaton([(1, ITEM), (2, "Map String Item items is what the reader holds for every open page today")], 10)
BIG = f'<img src="data:{"Ab9 " * 500}">'
HANGUL = "가나다 라마바 사아자 차카타 파하가 나다라 마바사 아자차 카타파 하가나"
KOREAN = leakage.automaton([(3, HANGUL)], 10)


@pytest.mark.parametrize(
    "text",
    [
        ITEM.replace("tools at", f"tools {BIG} at"), ITEM.replace("revision", "revi<b>sion</b>"), ITEM.replace("engineer", "en<i>gin</i>eer"), ITEM.replace("tools at", "tools<br/>at"),
        ITEM.replace("well known", "well-\nknown").replace("tools at", "tools <b>at</b>"), ITEM.replace("well known", "well-\nknown").replace("observes", "obser-\nves"),
        ITEM.replace("well known", "well​known").replace("engineer", "engi​neer"), ITEM.replace(" ", "<wbr/>"), ITEM.replace("before the", "before &CounterClockwiseContourIntegral; the"),
        ITEM.replace("tools", "&#x74;&#111;ols"), "if a <b then c " + ITEM, "<p>" + ITEM.replace(" ", "</p>\n<p>") + "</p>", ITEM.replace("340", "<x:y z='1'>340</x:y>"),
    ],
)
def test_layout_is_decided_place_by_place(text):
    assert leakage.leaked(text, AUTO) == {1} == {item for item, *_ in leakage.leaks(text, AUTO)}


def test_what_certainly_parts_words_does(spark):
    w = ITEM.split()
    for text in ("".join(w), ITEM.replace("engineer", "engi neer").replace("observes", "ob serves").replace("before", "be-fore"), ITEM.replace(" ", "<b></b>").replace("<b></b>", "")):
        assert leakage.leaked(text, AUTO) == set() == {item for item, *_ in leakage.leaks(text, AUTO)}
    # letters alike, words not
    assert leakage.leaked(" ".join("".join(w[i : i + 2]) for i in range(0, len(w), 2)), AUTO) == set()


def test_brackets_that_are_no_tags():
    assert leakage.leaked("so Map<String, Item> items is what the <b>reader</b> holds for every open page today", AUTO) == {2}


def test_letters_in_several_code_points_have_offsets():
    for kind in ("NFD", "NFC", "NFKD"):
        text = "앞 <b>" + unicodedata.normalize(kind, HANGUL) + "</b> 뒤"
        ((item, start, stop, n),) = leakage.leaks(text, KOREAN)
        assert leakage.leaked(text, KOREAN) == {3} == {item} and n == 10 and text[start:stop] == unicodedata.normalize(kind, HANGUL)
    ((_, start, stop, _),) = leakage.leaks("x " + ITEM.replace("engineer", "éngineer").replace("é", "e"), AUTO)
    assert (start, stop) == (2, 2 + len(ITEM) - 1)


def test_tags_without_end_are_read_once():
    began = time.time()
    assert len(leakage.forms("<a b " * 200_000)) == 1 and len(leakage.forms("<a" + " b" * 500_000)) == 1
    assert leakage.leaked("<a b " * 200_000 + ITEM, AUTO) == {1} and leakage.leaked("&" * 300_000 + "&a" * 300_000 + " " + ITEM, AUTO) == {1}
    assert leakage.leaked("a-\n" * 200_000 + " " + ITEM, AUTO) == {1}
    assert time.time() - began < 30


def test_found_pairs_are_those_of_the_spans(spark):
    from stratalens.llm import queries

    d = "/root/testdata/sf0.001"
    pairs = {tuple(r) for r in queries.p8_found(spark, d).collect()}
    assert pairs and pairs == {(r.doc_id, r.item_id) for r in queries.p8_spans(spark, d).collect()}
