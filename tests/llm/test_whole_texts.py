from kestrel.llm import handwritten as H
from kestrel.llm import mixing


def test_header_runs_to_the_end_of_the_leading_comment():
    licence = [f" word{k} of a long licence that goes on and on, with many words in each of its lines" for k in range(120)]
    for lines in (["#" + x for x in licence] + ["# Code generated by gen"], ["/*", *licence, "Code generated by gen", "*/"]):
        header = H.header_of("\n".join([*lines, "x = 1", "# not the header"]))
        assert "generated by gen" in header and "not the header" not in header
        assert "h:generated" in H.names_of(header, "a/b.py")
    assert H.header_of("x = 1\n" * 30 + "# generated by x") == ""


def test_shapes_are_counted_over_all_lines():
    text = "\n".join("+" * (k % 997) + "-" * (k // 997) + "x" for k in range(14_000))
    shape = H.shape_of(text)
    assert shape[10] == 1.0 and shape[11] == 0.0  # variety; repetitive


def test_all_tokens_count_for_a_source():
    many = [1] * 3000
    _, a = mixing.places([[*many, 77]])
    _, b = mixing.places([[*many, 78]])
    assert a.tolist() != b.tolist()
    doc, place = mixing.places([[5, 6, 5], [], [6]])
    assert doc.tolist() == [0, 0, 0, 1, 2, 2] and set(place[:3].tolist()) & set(place[4:].tolist())
