import pytest

from inkwell.llm import lookalike


@pytest.mark.parametrize("cp", [0xE0100, 0xE01EF, 0xE0001, 0xE0041, 0xE007F, 0x180B, 0x180C, 0x180D, 0x180F])
def test_selectors_and_tags_are_invisible(cp):
    assert lookalike.canonical([f"葛{chr(cp)}城", chr(cp), f"é{chr(cp)}"]) == ["葛城", "", "é"]


@pytest.mark.parametrize("cp", [0x30000, 0x323AF, 0xF0000, 0x10FFFD])
def test_other_high_signs_stay(cp):
    assert lookalike.canonical([f"a{chr(cp)}b", chr(cp) + chr(0xE0100)]) == [f"a{chr(cp)}b", chr(cp)]


def test_kana_with_the_shape_of_an_ideograph():
    from inkwell.llm.lookalike import canonical

    assert canonical(["陶エ在渡ロ讲カ量,ニ十字", "ハ月タ阳 ｴ"]) == ["陶工在渡口讲力量,二十字", "八月夕阳 工"]
