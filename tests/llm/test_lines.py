"""Line dedup: boilerplate of any shape, copies of documents, and lines of two documents."""

import numpy as np
import pytest

from flowlens.llm import line_templates


def kept_lines(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return [r["text"].split("\n") for r in line_templates.without_recurring_lines(df).orderBy("doc_id").collect()]


def own_lines(rng, n, words=12):
    return ["".join(rng.choice(list("aeiostrn"), 7)) + " " + " ".join("".join(rng.choice(list("aeiostrn"), 5)) for _ in range(words))
            for _ in range(n)]


@pytest.mark.parametrize("footer", [1, 2, 4])
@pytest.mark.parametrize("joint", ["\n", "\n\n"])
def test_footers_and_paragraphs(spark, footer, joint):
    rng = np.random.default_rng(footer)
    shared = own_lines(rng, footer - 1) + ["All rights reserved."]
    bodies = [own_lines(rng, 5) for _ in range(8)]
    found = kept_lines(spark, [joint.join(b + shared) for b in bodies])
    assert found[0] == joint.join(bodies[0] + shared).split("\n")
    for body, lines in zip(bodies[1:], found[1:]):
        assert [x for x in lines if x] == body


def test_lines_of_two_documents(spark):
    rng = np.random.default_rng(5)
    passage, short = " ".join(own_lines(rng, 10)), "He went home again."
    bodies = [own_lines(rng, 9, 30) for _ in range(4)]
    found = kept_lines(spark, ["\n".join([*bodies[0], passage, short]), "\n".join([passage, *bodies[1], short]),
                               "\n".join(bodies[2]), "\n".join(bodies[3])])
    assert passage in found[0] and found[1] == [*bodies[1], short]  # a short line takes three documents
    assert found[2:] == bodies[2:]


def test_copies_keep_their_lines_but_not_boilerplate(spark):
    rng = np.random.default_rng(6)
    shared, body = own_lines(rng, 1)[0], own_lines(rng, 12)
    copies = []
    for i in range(60):
        lines = list(body)
        lines[i % 12] = lines[i % 12] + f" changed{chr(97 + i % 26)}{chr(97 + i // 26)}"
        copies.append(lines)
    others = [own_lines(rng, 6) for _ in range(10)]
    found = kept_lines(spark, ["\n".join([shared, *x]) for x in others] + ["\n".join([*x, shared]) for x in copies + [body, body]])
    assert found[0] == [shared, *others[0]]
    assert found[1:10] == others[1:]
    assert found[10:] == copies + [body, body]


def test_the_first_text_keeps_the_line_in_its_copies_too(spark):
    rng = np.random.default_rng(7)
    shared, body = own_lines(rng, 1)[0], own_lines(rng, 5)
    others = [own_lines(rng, 6) for _ in range(3)]
    texts = ["\n".join([*body, shared])] * 2 + ["\n".join([shared, *x]) for x in others]
    found = kept_lines(spark, texts)
    assert ["\n".join(x) for x in found[:2]] == texts[:2] and found[2:] == others


def test_lines_of_long_and_awkward_texts(spark, awkward):
    rng = np.random.default_rng(8)
    long = own_lines(rng, 3000)
    assert kept_lines(spark, ["\n".join(long), "\n".join(own_lines(rng, 5) + long[:1]), "\n\n", "\r\n \t"])[1:] [0][-1] != long[0]
    found = line_templates.without_recurring_lines(awkward)
    assert found.count() == awkward.count() and found.columns[:len(awkward.columns)] == awkward.columns
