import itertools
import random

from sparkloom.llm import markup

PAGE = (
    "<html><head><title>t</title><style>.x{color:red}</style></head><body><nav><ul><li><a href='a'>Home</a></li><li><a href='b'>News</a></li></ul></nav>"
    "<script>var a=1;if(a<b){b()}</script><h2>Title</h2><p>A long text about rivers and stones that runs on for a while.</p>"
    "<ul><li>First stone of the river</li></ul><p>More of it.</p><footer><a href='x'>Imprint</a> <a href='y'>Terms</a></footer></body></html>"
)


def test_boilerplate_is_cut_off_and_structure_told():
    text, moved, kinds, structure = markup.clean(PAGE, [PAGE.index("A long text"), PAGE.index("More of")])
    assert kinds == {"html"}
    for gone in ("Home", "News", "color", "var a", "Imprint", "<"):
        assert gone not in text
    assert text[moved[0] :].startswith("A long text") and text[moved[1] :].startswith("More of it.")
    told = {(kind, level, text[a:b].strip()) for kind, level, a, b in structure}
    assert ("heading", 2, "Title") in told and ("item", 1, "- First stone of the river") in told


def test_structure_of_other_markup():
    body = "# One\n\nSome `x` and $a_1$\n\n```\ncode here\n```\n\n- item\n- two\n\nHead\n====\n\n\\subsection{Deep} text\n\n== Wiki ==\n"
    text, _, _, structure = markup.clean(body, [])
    told = [(kind, level, text[a:b].strip()) for kind, level, a, b in structure]
    for want in (("heading", 1, "One"), ("formula", 0, "$a_1$"), ("code", 0, "code here"), ("item", 1, "- item"), ("heading", 1, "Head"), ("heading", 2, "Wiki")):
        assert want in told
    assert any(kind == "heading" and level == 2 and words.startswith("Deep") for kind, level, words in told)


def test_a_page_without_block_elements_loses_nothing():
    assert markup.clean("a <b>bold</b> word", [])[0] == "a bold word"
    assert markup.clean("<script>never closed", [])[0].strip() == "never closed"


def test_the_classifier_tells_markup_from_its_look_alikes():
    weights = markup.fitted_nodes()
    rows = []
    for text, label in markup.labelled_snippets(1500, 77):
        rows += [((sum(weights.get(f, 0.0) for f in markup.node_features(text, n.start, n.end, n.shape, n.name)) > 0) == label) for n in markup.nodes_of(text, 0.0)]
    assert sum(rows) > 0.88 * len(rows)  # a tenth of the snippets may be either


def test_a_lone_sign_among_its_like_is_markup_and_alone_it_is_not():
    assert not markup.markup_nodes(": thing")
    assert {n.shape for n in markup.markup_nodes("== Head ==\n: thing\n")} == {"wheading", "witem"}


def test_the_cut_is_a_minimum():
    rng = random.Random(2)
    for _ in range(40):
        costs = [rng.uniform(-2, 2) for _ in range(7)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.5]
        value = lambda labels: sum(max(0, -c if on else c) for c, on in zip(costs, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])
        best = min(value(labels) for labels in itertools.product([False, True], repeat=7))
        assert abs(value(markup.minimum_cut(costs, edges)) - best) < 1e-9
