from orbweaver.llm import quality


def test_distinct_words_are_counted_to_the_end():
    head = [f"w{i}" for i in range(400)]
    share = lambda tokens: quality.style(" ".join(tokens))[10]
    assert share(head) == 1 and share(["a", "b"] * 100) == 0.01
    assert share(head + ["same"] * 3600) == (400 + 9) / 4000
    assert share(head * 3) == 1
