from sparkloom.llm import subjects as subj

AREAS = [("sport", ["goalkeeper"]), ("law", ["plaintiff"])]


def shares(spark, docs, labels):
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    areas = spark.createDataFrame(AREAS, "subject string, sample_terms array<string>")
    known = spark.createDataFrame(labels, "doc_id long, subject string")
    return {(r.doc_id, r.subject) for r in subj.subject_shares(documents, areas, known).collect()}


def test_a_label_holds_in_the_last_vote_where_the_words_do_not_decide(spark):
    docs = [(i, "Nobody left that banquet early.") for i in range(13)]
    got = shares(spark, docs, [(i, "sport") for i in range(6)] + [(i, "law") for i in range(6, 13)])
    assert got == {(i, "sport") for i in range(6)} | {(i, "law") for i in range(6, 13)}


def test_rounds_go_on_until_no_term_changes_sides(spark, monkeypatch):
    # unlabelled documents turn "banquet" to law in the first round; only a second one can tell that it stays
    docs = [(i, "The goalkeeper joined the banquet after noon.") for i in range(3)] + [(i, "Plaintiff left the banquet again.") for i in range(3, 30)]
    seen, plain = [], subj._scored
    monkeypatch.setattr(subj, "_scored", lambda graph, labels, width: seen.append(labels) or plain(graph, labels, width))
    shares(spark, docs, [(i, "sport") for i in range(3)])
    # one vote on the labels of seeds, the rounds, the last vote
    assert 1 < len(seen) - 2 < subj.MAX_ROUNDS
    sides = [{r.term: r.side for r in labels.select("term", "side").collect()} for labels in (seen[1], seen[-1])]
    assert any(sides[1].get(term) not in (None, side) for term, side in sides[0].items())


def test_without_edges_only_seeds_and_code_keep_subjects(spark, monkeypatch):
    docs = [(i, "The goalkeeper joined the banquet after noon.") for i in range(4)] + [(9, "The goalkeeper left again."), (8, "import os\nfor x in y:\n    return x;\n")]
    assert shares(spark, docs, [(i, "sport") for i in range(3)]) == {(i, "sport") for i in (0, 1, 2, 3, 9)}
    plain = subj._scored
    monkeypatch.setattr(subj, "_scored", lambda graph, labels, width: plain(graph, labels.limit(0), width))
    assert shares(spark, docs, [(i, "sport") for i in range(3)]) == {(i, "sport") for i in range(3)}


def test_a_trusted_seed_keeps_all_its_labels_and_a_wrong_one_is_let_go(spark):
    sport, law = "The goalkeeper joined the midfielder after noon. ", "The plaintiff sued the notary after noon. "
    docs = [(i, sport * 6) for i in range(6)] + [(i, law * 6) for i in range(6, 12)] + [(20, sport * 9 + "\n\n" + law), (21, law * 6)]
    labels = [(i, "sport") for i in range(6)] + [(i, "law") for i in range(6, 12)] + [(20, "sport"), (20, "law"), (21, "sport")]
    got = shares(spark, docs, labels)
    assert {s for d, s in got if d == 20} == {"sport", "law"}  # by the vote alone law falls short of a fifth
    assert {s for d, s in got if d == 21} == {"law"}
