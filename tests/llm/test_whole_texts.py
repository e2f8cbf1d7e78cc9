"""Licence texts and training texts are taken whole."""

import numpy as np
import pytest

from cutroom.llm import language_model, license_scan
from cutroom.llm.session import Shelf


def test_clauses_of_whole_licences_are_found(spark):
    read = lambda name: license_scan.clauses_of((license_scan.FOLDER / name).read_text())
    docs = [
        ("mit", next(x for x in read("mit__expat.txt") if "WARRANTY OF ANY KIND" in " ".join(x.split()))),
        ("apache", next(x for x in read("apache__2.0.txt") if "Grant of Patent License" in " ".join(x.split()))),
        ("bsd", next(x for x in read("bsd__3.txt") if "ARE DISCLAIMED" in " ".join(x.split()))),
        ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ]
    rows = spark.createDataFrame([(label, f"alpha beta gamma\n{x}\ndelta") for label, x in docs], "doc_id string, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.digest(license_scan.scan(rows)).collect()}
    assert all(label in got[label] for label, _ in docs), got
    assert {"lgpl", "epl", "cc0", "unlicense", "mpl", "gpl"} <= {label for label, _ in license_scan.clauses()}


def test_training_counts_moves_over_whole_texts(spark):
    """A round over one long text is the same as expected counts over it in one piece; no transition is left out."""
    docs = spark.createDataFrame([(0, " ".join("abcd"[i * i % 4] for i in range(1500))), (1, "a b")], "doc_id long, text string")
    base = language_model.base_model(language_model.count_words(docs))
    start = language_model.Hmm.start(base, 2)
    got = language_model.baum_welch(language_model.symbol_texts(docs, base, Shelf(spark)), base, 1, states=2)
    texts = [r.text.split() for r in docs.orderBy("doc_id").collect()]
    _, hashes, begins = next(language_model._texts(docs.coalesce(1).toArrow().to_batches(), 1))
    assert np.diff(begins).tolist() == [len(t) + 1 for t in texts]
    for chunk in (100, 10**6):
        _, move, _ = start.expect(base.symbols_of(hashes), begins, chunk)
        assert move.sum() == pytest.approx(sum(len(t) for t in texts))
        move = move + 1 / 2
        assert got.move == pytest.approx(move / move.sum(1, keepdims=True), rel=1e-6)
