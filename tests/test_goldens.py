"""Literal expected values of single operators."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from kinloom.functions import recode as rc
from kinloom.operators import graph, intervals, joins, kernels, sequence
from kinloom.sources import text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_segments_with_value(spark):
    bits = "1001000110000111"
    df = spark.createDataFrame([(0, k, int(b)) for k, b in enumerate(bits)], "g int, pos long, v int")
    get = lambda least: rows(sequence.segments_with_value(df, ["g"], "pos", "v", 0, least), "start", "stop")
    assert get(1) == [(1, 3), (4, 7), (9, 13)]
    assert get(3) == [(4, 7), (9, 13)]
    assert get(5) == []


def test_run_lengths(spark):
    df = spark.createDataFrame([(0, k, c) for k, c in enumerate("AAAABBBCCDAABBB")], "g int, pos long, v string")
    assert rows(sequence.runs(df, ["g"], "pos", "v"), "first", "last", "v") == [(0, 3, "A"), (4, 6, "B"), (7, 8, "C"), (9, 9, "D"), (10, 11, "A"), (12, 14, "B")]


def test_intervals(spark):
    df = lambda x: spark.createDataFrame([(0, *p) for p in x], "g int, start long, stop long")
    a, b = df([(0, 2), (4, 7), (10, 100)]), df([(1, 5), (6, 20)])
    assert rows(intervals.intersection(a, b, ["g"], 8), "start", "stop") == [(1, 2), (4, 5), (6, 7), (10, 20)]
    assert rows(intervals.either(a, b, ["g"]), "start", "stop") == [(0, 100)]
    assert rows(intervals.union(df([(0, 7), (4, 9), (2, 5), (10, 100)]), ["g"]), "start", "stop") == [(0, 9), (10, 100)]


def test_group_to_disjoint(spark):
    pairs = [(0, 50, 1, 2), (50, 100, 1, 3), (50, 300, 2, 4), (100, 200, 3, 4)]
    df = spark.createDataFrame([(0, *p) for p in pairs], "k long, start long, stop long, a long, b long")
    got = rows(kernels.disjoint_groups(intervals.covered_atoms(df, ["k"], 64)), "lo", "hi", "members")
    assert got == [(0, 50, [1, 2]), (50, 100, [1, 3]), (50, 100, [2, 4]), (100, 200, [2, 3, 4]), (200, 300, [2, 4])]


def test_range_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    a = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 300, 60), rng.integers(0, 40, 60), strict=True)]
    b = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 300, 60), rng.integers(1, 90, 60), strict=True)]
    x = spark.createDataFrame([(k, *p) for k, p in enumerate(a)], "i int, xa long, xb long")
    y = spark.createDataFrame([(k, *p) for k, p in enumerate(b)], "j int, ya long, yb long")
    want = sorted((i, j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if p[0] < p[1] and p[0] < q[1] and q[0] < p[1])
    assert rows(joins.range_join(x, y, "xa", "xb", "ya", "yb", 17), "i", "j") == want


def test_nearest_ties(spark):
    p = spark.createDataFrame([(5,), (0,), (99,)], "pos long")
    g = spark.createDataFrame([(4,), (6,), (20,)], "pos long")
    assert rows(joins.nearest(p, g, "pos", []), "pos", "n_pos") == [(0, 4), (5, 6), (99, 20)]
    assert rows(joins.nearest(p, g, "pos", [], tie_right=False), "pos", "n_pos") == [(0, 4), (5, 4), (99, 20)]


def test_complete_haplotype(spark):
    cases = [(0, 1, 1, 2, 2), (0, 2, 1, 2, 1), (0, 1, 1, 1, 1), (0, 1, 0, 2, 0), (0, 0, 1, 2, 0), (2, 1, 1, 1, 2), (0, 1, 2, 2, 0)]
    df = spark.createDataFrame([c[:4] for c in cases], "h int, o int, a int, b int").select(rc.complete_haplotype(F.col("h"), F.col("o"), F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in df.collect()] == [c[4] for c in cases]


def test_binomial_p(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (5, 5)], "a long, b long").select(rc.binomial_p(F.col("a"), F.col("b")).alias("p"))
    assert np.allclose([r.p for r in df.collect()], [1.0, 1 - 15 / 16 + 5 / 16, 1.0])


def test_haplotype_posterior():
    want = [0.66083, 0.74808, 0.79457, 0.81822, 0.82813]
    got = kernels.ibd_posterior(np.arange(10), np.ones(10, int), np.ones(10, int), np.full(10, 0.5), 0.5, 0.25)
    assert np.allclose(got, want + want[::-1], atol=1e-5)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    pi, a, b = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), (7, 2)), rng.random((8, 2))
    best = max(itertools.product((0, 1), repeat=8), key=lambda s: pi[s[0]] * b[0, s[0]] * np.prod([a[t - 1, s[t - 1], s[t]] * b[t, s[t]] for t in range(1, 8)]))
    assert kernels.viterbi(pi, a, b).tolist() == list(best)


def test_greedy_colors():
    path = [(k, k + 1) for k in range(9)]
    assert [c for _, c in sorted(graph.greedy_colors(path).items())] == [0, 1] * 5
    assert [c for _, c in sorted(graph.greedy_colors([*path, (0, 2), (0, 3)]).items())] == [0, 1, 2, 1, 0, 1, 0, 1, 0, 1]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(k, k + 1) for k in range(100, 140)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == kernels.union_find(edges)


def test_levels(spark):
    people = [(1, 0, 0), (2, 0, 0), (3, 1, 2), (4, 0, 0), (5, 1, 2), (6, 3, 4), (7, 3, 4), (8, 7, 5)]
    df = spark.createDataFrame(people, "id long, father long, mother long")
    assert rows(graph.levels(df), "id", "depth") == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 2), (7, 2), (8, 3)]


def test_cliques_and_imputation():
    full = list(itertools.combinations(range(6), 2))
    assert kernels.naive_cliques([*full, (0, 9)]) == [[0, 1, 2, 3, 4, 5]]
    assert kernels.affinity_cliques(full, [1.0] * len(full)) == [[0, 1, 2, 3, 4, 5]]
    got = kernels.impute_snp({1: (1, 1), 2: (1, 2), 3: (0, 0)}, [[(1, 0), (2, 0)], [(2, 1), (3, 1)]])
    assert got == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 2, (3, 1): 2}


def test_gene_drop_transmits():
    got = kernels.gene_drop([(1, 0, 0), (2, 0, 0), (3, 1, 2)], 7)
    assert got[3][0] in got[1] and got[3][1] in got[2]


def test_text_round_trips(spark, tmp_path):
    calls = spark.createDataFrame([(22, "rs1", 0.5, 100, p, a, b) for p, (a, b) in enumerate([(1, 2), (0, 0), (2, 2)])], "chrom int, name string, cm double, bp long, pos int, a0 int, a1 int")
    text.write_tped(calls, str(tmp_path / "x.tped"))
    back = text.read_tped(spark, str(tmp_path / "x.tped"))
    assert rows(back, "chrom", "name", "cm", "bp", "pos", "a0", "a1") == rows(calls, "chrom", "name", "cm", "bp", "pos", "a0", "a1")
    names = ("variant_id", "chrom", "start", "stop", "kind", "ref", "alt", "xref", "pos", "tag", "a0", "a1")
    v = spark.createDataFrame([(7, "22", 10, 11, "snp", "A", "G", "rs7", p, t, a, b) for p, (t, a, b) in enumerate([(1, 0, 2), (2, 1, 1)])], "variant_id long, chrom string, start long, stop long, kind string, ref string, alt string, xref string, pos int, tag int, a0 int, a1 int")
    text.write_variants(v, str(tmp_path / "v"))
    assert rows(text.read_variants(spark, str(tmp_path / "v")), *names) == rows(v, *names)
    (tmp_path / "s").write_text("0 9 0 90 5 1 2 0\n")
    seg = text.read_segments(spark, str(tmp_path / "s"))
    text.write_segments(seg, str(tmp_path / "s2"))
    assert rows(text.read_segments(spark, str(tmp_path / "s2")), "s0", "a0", "s1", "a1") == [(2, 0, 5, 1)]
    (tmp_path / "vcf").write_text("##x\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT:GQ\t0/1:40\t1/1:10\t./.:50\n")
    assert rows(text.read_vcf(spark, str(tmp_path / "vcf")), "pos", "a0", "a1") == [(0, 1, 2), (1, 0, 0), (2, 0, 0)]
    (tmp_path / "ibd").write_text("f\t1\t2\t22" + "\t1\t2\tr\ts\t3\t0.5" * 2 + "\n")
    assert text.read_ibdld(spark, str(tmp_path / "ibd")).count() == 2


def test_stream(spark, tmp_path):
    from kinloom.streaming import counts

    spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "snp long, g int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("snp long, g int").parquet(str(tmp_path / "in"))
    q = counts.genotype_counts_stream(stream).writeStream.format("memory").queryName("gc").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("gc"), "snp", "n11", "n12", "n22", "n00") == [(1, 1, 1, 0, 0), (2, 0, 0, 1, 0)]


def test_binomial_of_many(spark):
    """Against logarithms of factorials, at counts where powers of a half vanish."""
    import math

    def twin(x, y):
        n = x + y
        inside = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(min(x, y) + 1, max(x, y) + 1))
        return 1 - inside

    rows = [(515, 515), (700, 715), (3, 9), (0, 1), (1200, 1300), (0, 1415)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", rc.binomial_p(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        assert abs(r.p - twin(r.a, r.b)) < 1e-9


def test_trio_errors_are_cleared(spark):
    """A child that its parents can't have is found and zeroed, and only it."""
    from kinloom.operators import phasing

    calls = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 2), (2, 1, 1, 2), (2, 2, 1, 1), (2, 3, 1, 2), (3, 1, 2, 2), (3, 3, 1, 1)], "snp long, smp long, a0 int, a1 int")
    kinds = spark.createDataFrame([(3, 1, 2)], "smp long, father_smp long, mother_smp long")
    bad = phasing.trio_errors(calls, kinds)
    assert sorted(map(tuple, bad.collect())) == [(1, 3), (3, 3)]
    left = phasing.clear_errors(phasing.from_homozygous(calls), bad).where("smp = 3").collect()
    assert sorted((r.snp, r.a0, r.a1, r.h0, r.h1) for r in left) == [(1, 0, 0, 0, 0), (2, 1, 2, 0, 0), (3, 0, 0, 0, 0)]


def test_levels_of_a_cycle(spark):
    """Founder 1 has child 2; 2 and 3 are each other's children."""
    import pytest

    df = spark.createDataFrame([(1, 0, 0), (2, 1, 3), (3, 2, 0)], "id long, father long, mother long")
    with pytest.raises(ValueError):
        graph.levels(df)


def test_imputation_through_a_clique(spark):
    """A homozygous sample fixes its cliques; a heterozygous member's other haplotype follows and goes on to its own."""
    calls = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2), (1, 3, 0, 0)], "snp long, smp long, a0 int, a1 int")
    cliques = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 2, 0), (1, 1, 2, 1), (1, 1, 3, 0)], "snp long, grp long, smp long, allele int")
    got = {(r.smp, r.allele): r.v for r in kernels.impute(calls, cliques).collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 2, (3, 0): 2}


def test_imputation_from_partial_genotypes():
    """A genotype called in part completes a haplotype where that leaves one choice, and the new one goes on to its clique."""
    cliques = [[(1, 0), (2, 0), (4, 1)], [(2, 1), (5, 0)]]
    got = kernels.impute_snp({1: (1, 1), 2: (0, 2), 4: (1, 0)}, cliques)
    assert got == {(1, 0): 1, (1, 1): 1, (2, 0): 1, (2, 1): 2, (4, 1): 1, (5, 0): 2}
    assert [kernels.other_allele(1, *g) for g in ((1, 2), (2, 1), (2, 0), (0, 2), (0, 1), (1, 0), (2, 2), (0, 0))] == [2, 2, 2, 2, 0, 0, 0, 0]


def test_imputation_of_many_snps_at_once(spark):
    """Many SNPs in one call give what each gives alone: partial genotypes, samples without a call, members named twice,
    haplotypes in two cliques, both haplotypes of a sample in one, SNPs without cliques or without calls."""
    rng = np.random.default_rng(5)
    calls, members, want = [], [], []
    for snp in range(60):
        genotype = {int(s): (int(rng.integers(3)), int(rng.integers(3))) for s in rng.choice(15, rng.integers(12), replace=False)}
        cliques = [sorted((int(rng.integers(15)), int(rng.integers(2))) for _ in range(rng.integers(1, 7))) for _ in range(rng.integers(6))]
        calls += [(snp * 7, s, a, b) for s, (a, b) in genotype.items()]
        members += [(snp * 7, 3 * k, s, a) for k, c in enumerate(cliques) for s, a in c]
        want += [(snp * 7, s, a, v) for (s, a), v in kernels.impute_snp(genotype, cliques).items()]
    left = spark.createDataFrame(calls, "snp long, smp long, a0 int, a1 int")
    right = spark.createDataFrame(members, "snp long, grp long, smp long, allele int")
    assert {m[0] for m in members} - {c[0] for c in calls} and {c[0] for c in calls} - {m[0] for m in members}
    for most in (1, 40, 1 << 17):
        assert rows(kernels.impute(left, right, most), "snp", "smp", "allele", "v") == sorted(want)
    assert kernels.impute(left.limit(0), right).count() == 0
    plan = kernels.impute(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan


def test_median_of_any_width(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    for n, width in ((8, 3), (8, 7), (2, 5), (1, 5)):
        df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values[:n])], "k int, at long, v int")
        padded = np.pad(np.array(values[:n]), width // 2, mode="symmetric")
        want = [(i, int(np.median(padded[i : i + width]))) for i in range(n)]
        assert rows(sequence.median(df, ["k"], "at", "v", width), "at", "m") == want


def test_parents_take_the_last_childs_allele(spark):
    calls = spark.createDataFrame([(1, 2, 0, 0), (1, 3, 1, 0), (1, 4, 1, 2), (1, 5, 0, 1)], "snp long, smp long, a0 int, a1 int")
    haps = spark.createDataFrame([(1, 4, 1, 2), (1, 5, 2, 1), (1, 6, 1, 0)], "snp long, smp long, h0 int, h1 int")
    family = spark.createDataFrame([(4, 2, 3), (5, 2, None), (6, 2, 3)], "smp long, father long, mother long")
    from kinloom.operators import phasing

    got = rows(phasing.impute_parents(calls, haps, family), "smp", "a0", "a1")
    assert got == [(2, 2, 0), (3, 1, 2), (4, 1, 2), (5, 0, 1)]


def test_origin_by_kinship(spark):
    """Members of the first clique are kin of the father, those of the second of the mother: the sample is as it should be."""
    from kinloom.operators import origin

    cliques = [(0, s, 0, 0) for s in (1, 2, 3, 4)] + [(0, 1, 1, 1)] + [(0, s, 1, 1) for s in (5, 6, 7)]
    cl = spark.createDataFrame(cliques, "place long, smp long, allele int, grp long")
    founders = spark.createDataFrame([(s, 100 + s, 200 + s) for s in range(1, 8)], "smp long, father long, mother long")
    near = lambda p, s: 0.25 if (p < 200) == (s < 5) else 0.125
    kin = spark.createDataFrame([(p, s, near(p, s)) for q in range(1, 8) for p in (100 + q, 200 + q) for s in range(1, 8)], "id long, smp long, k double")
    got = origin.flip_measure(cl, founders, kin)
    log = np.log(4)
    assert [(r.smp, r.n0, r.n1, round(r.sep, 9)) for r in got.collect()] == [(1, 3, 3, round(log / (1 + log), 9))]
    assert rows(origin.flip_decision(got), "smp", "n_plus", "n_minus", "phase") == [(1, 1, 0, 1)]
    assert origin.flip_measure(cl.limit(0), founders, kin).count() == 0


def test_more_layouts(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    lines = lambda n: sorted(r.value for r in spark.read.text(at(n)).collect())
    calls = spark.createDataFrame([(1, 7, 1, 2), (1, 8, 0, 2), (2, 7, 0, 0)], "snp long, smp long, a0 int, a1 int")
    text.write_long(calls, at("long"))
    assert lines("long") == ["1,7,1,2", "1,8,0,2", "2,7,0,0"]
    text.write_lgen(calls, at("lgen"))
    assert lines("lgen") == ["7 1 1 2", "7 2 0 0", "8 1 0 2"]
    text.write_impute2(calls, at("impute2"))
    assert lines("impute2") == ["1 0 1 ? ?", "2 ? ?"]
    (tmp_path / "sets").write_text("0 9 0 90 5 1 2 0\n3 4 30 40\n")
    text.write_segment_sets(text.read_segment_sets(spark, at("sets")), at("sets2"))
    assert lines("sets2") == lines("sets")
    (tmp_path / "frames").write_text("22 4 1 9\n22 3\n")
    text.write_frames(text.read_frames(spark, at("frames")), at("frames2"))
    assert lines("frames2") == lines("frames")
    pairs = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.25), (3, 3, 0.5), (2, 2, 0.5)], "id1 long, id2 long, k double")
    assert rows(text.kinship_lines(pairs), "place", "line") == [(0, "1 2 3"), (1, "0.5 0.0 0.25"), (2, "0.0 0.5 0.0"), (3, "0.25 0.0 0.5")]
    turned = text.transpose(spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "d"])], "row int, cells array<string>"))
    assert rows(turned, "row", "cells") == [(0, ["a", "c"]), (1, ["b", "d"])]


def test_more_streams(spark, tmp_path):
    from kinloom.streaming import counts

    typed = spark.createDataFrame([(1, 1, 1, 2)], "snp long, smp long, a0 int, a1 int")
    spark.createDataFrame([(1, 1, 0, 2, 3), (1, 2, 1, 0, 3)], "snp long, smp long, b0 int, b1 int, tag int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("snp long, smp long, b0 int, b1 int, tag int").parquet(str(tmp_path / "in"))
    counts.override_stream(stream, typed).writeStream.format("memory").queryName("ov").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("ov"), "smp", "o0", "o1", "tag") == [(1, 1, 2, 0), (2, 1, 0, 3)]
    spark.sql("select timestamp'2024-01-01 00:00:10' ts, 'a' event_type union all select timestamp'2024-01-01 00:00:50', 'a'").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    counts.windowed_counts(events, "1 minute", "1 minute").writeStream.format("memory").queryName("wc").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("wc"), "event_type", "n") == [("a", 2)]
