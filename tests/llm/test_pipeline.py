import corpus_pipeline
from tierblend.llm import decontaminate, licenses, secrets
from tierblend.llm.base import table

SCHEMA = "doc_id long, text string, family string, score string, label string"


def test_licenses(spark):
    plain = [(i, f"plain words number {i}\nin some lines of prose about the weather", "", "", "") for i in range(60)]
    rows = plain + [(100, "text\n\nReleased under the MIT License.", "", "", ""), (101, None, "", "", ""), (102, "", "", "", ""),
                    (103, "x " * 100_000 + "\nLicensed under the Apache License, Version 2.0.", "", "", ""),
                    (None, "This work is licensed under the GNU General Public License, version 3.", "", "", "")]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(df, licenses.train(df)).collect()}
    assert {k: r.family for k, r in got.items() if r.confirmed} == {100: "MIT", 103: "Apache", None: "GPL"}
    assert got[101].n_paragraphs == 0 and all(got[i].family is None for i in range(60))
    assert licenses.scan(df.where("false"), licenses.train(df.where("false"))).count() == 0


def test_stages_take_effect(spark, sf):
    docs, sizes = table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > 0
    assert not decontaminate.judge(decontaminate.find_hits(docs, table(spark, sf, "benchmark"))).where("contaminated").count()
    assert not secrets.scan(docs).where("size(filter(spans, s -> s.rank < 3)) > 0").count()
    assert corpus_pipeline.encoding_stage(spark, docs, sf).where("decoded_sha256 is null").count() == 0


def test_wrapped_licenses(spark):
    plain = [(i, f"plain words number {i}\nin some lines of prose about the weather", "", "", "") for i in range(60)]
    mit = ("// Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "// of this software and associated documentation files (the \"Software\"), to deal")
    bsd = (" * Redistribution and use in source and binary forms, with or without\n"
           " * modification, are permitted provided that the following conditions\n * are met:")
    gpl = ("This program is free software: you can redistribute it and/or modify\n"
           "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation")
    rows = [(100, "some code\n\n" + mit, "", "", ""), (101, "/*\n" + bsd, "", "", ""), (102, gpl, "", "", ""),
            (103, "a line of prose before\n" + gpl.replace("\n", " \r\n") + "\nand more prose", "", "", ""),
            (104, gpl.replace("modify\nit", "modify\n\nit"), "", "", "")]
    df = spark.createDataFrame(plain + rows, SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(df, licenses.train(df)).collect() if r.doc_id >= 100}
    assert {k: r.evidence for k, r in got.items()} == {100: "2-3:MIT", 101: "1-2:BSD", 102: "0-1:GPL", 103: "1-2:GPL", 104: ""}
    assert [got[k].confirmed for k in sorted(got)] == [True] * 4 + [False]


def test_neighbours_of_license_families_are_unknown(spark):
    plain = [(i, f"plain words number {i}\nin some lines of prose about the weather", "", "", "") for i in range(60)]
    work = "This work is licensed under "
    rows = [(100, work + "the GNU Lesser General Public License, version 3.", "", "", ""),
            (101, "Licensed under CC BY-SA 4.0.", "", "", ""),
            (102, work + "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "", "", ""),
            (103, "Licensed under the Mozilla Public License, Version 2.0.", "", "", ""),
            (104, work + "the GNU Affero General\nPublic License, version 3.", "", "", ""),
            (200, work + "the GNU General Public License, version 3.", "", "", ""), (201, "Licensed under CC BY 4.0.", "", "", ""),
            (202, "Licensed under CC BY-NC 4.0.", "", "", "")]
    df = spark.createDataFrame(plain + rows, SCHEMA)
    got = {r.doc_id: r.family for r in licenses.scan(df, licenses.train(df)).collect() if r.confirmed}
    assert got == {200: "GPL", 201: "CC-BY", 202: "CC-BY-NC"}


def test_background_holds_license_like_and_long_paragraphs(spark):
    texts = ["Copyright 2020 by nobody", "no permission is given here", "long " * 600 + "licence", "Released under the MIT License."]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(w[0] for _, w in licenses.background(df)) == ["copyright", "long", "no"]
