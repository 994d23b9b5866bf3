import pytest

from inkwell.llm import scan


class Counted:
    def __init__(self, counts, times):
        self.counts, self.times = counts, times

    def n(self, word):
        return self.counts.get(word.lower(), 0) * self.times


COUNTS = {"quatho": 5, "nor": 8, "home": 40, "baked": 35, "station": 60, "sta": 2, "tion": 2} | dict.fromkeys(scan._hyphened("home", "baked"), 30) | dict.fromkeys(scan._hyphened("sta", "tion"), 1)


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_split_words_do_not_change_with_the_size(times):
    words = Counted(COUNTS, times)
    assert scan.is_split_word("quatho", "nor", words) and scan.is_split_word("sta", "tion", words) and not scan.is_split_word("home", "baked", words)


def test_compounds_are_counted_inside_lines(spark):
    d = spark.createDataFrame([("some home-baked bread, well-to-do\nquatho nor quatho-\nnor",)] * 3, "text string")
    words = scan.Words(scan.corpus_counts(d))
    assert all(words.n(k) == 3 for a, b in (("home", "baked"), ("well", "to"), ("to", "do")) for k in scan._hyphened(a, b))
    assert not scan.is_split_word("home", "baked", words) and scan.is_split_word("quatho", "nor", words)
