import pytest

from granary import cli


def test_help(capsys):
    assert cli.parse([]) is None and cli.parse(["--help"]) is None and cli.parse(["-h"]) is None
    assert "BIG_FIM | FIN | FP_GROWTH" in capsys.readouterr().out
    assert cli.parse(["FIN", "--help"]) is None
    assert "--run-type" in capsys.readouterr().out


def test_defaults():
    o = cli.parse(["BIG_FIM", "--input-file-name", "x"])
    assert (o.min_supp, o.input_parts_num, o.persist_input, o.print_intermediate_res, o.cnt_only, o.print_all_fis, o.sleep_seconds, o.use_kryo, o.spark_master_url) == (0.9, 2, False, True, True, False, 0, False, "")
    assert (o.start_eclat_prefix_len, o.curr_to_prev_res_ratio_threshold, o.eclat_use_diff_sets, o.eclat_use_squeezing, o.eclat_parts_num) == (3, 1.1, True, False, None)
    assert cli.parse(["FIN", "--run-type", "PAR_SPARK"]).itemset_len_for_seq_processing == 1


@pytest.mark.parametrize(
    "args, text",
    [
        (["NONE"], "Unknown algorithm 'NONE'"),
        (["FIN"], "Missing mandatory option '--run-type'"),
        (["FIN", "--run-type", "X"], "Bad value of '--run-type X'"),
        (["FP_GROWTH", "--min-supp", "x"], "Bad value of '--min-supp x'"),
        (["BIG_FIM", "--eclat-parts-num", "q"], "Bad value of '--eclat-parts-num q'"),
        (["FP_GROWTH", "--print-all-fis", "true"], "Contradicting options"),
        (["FP_GROWTH", "--none", "1"], "unrecognized"),
    ],
)
def test_errors(args, text):
    with pytest.raises(ValueError, match=text):
        cli.parse(args)


@pytest.mark.parametrize(
    "args",
    [
        ["FP_GROWTH", "--cnt-only", "false"],
        ["BIG_FIM", "--eclat-cnt-only", "false", "--start-eclat-prefix-len", "1"],
        ["FIN", "--run-type", "PAR_SPARK", "--cnt-only", "false"],
        ["FIN", "--run-type", "SEQ_PURE_JAVA", "--cnt-only", "false", "--persist-input", "true"],
    ],
    ids=lambda a: "-".join(a[:3]),
)
def test_runs(spark, tmp_path, capsys, args):
    path = tmp_path / "t.txt"
    path.write_text("1 2 3 \n1 2 \n2 3 \n1 2 3 \n")
    cli.main([*args, "--input-file-name", str(path), "--min-supp", "0.5", "--print-all-fis", "true"])
    out = capsys.readouterr().out
    assert "Total results: 7" in out
    lines = [x for x in out.splitlines() if x.startswith("FI: ")][-7:]
    assert lines[0] == "FI: [1, 2, 3]: 2" and lines[-3:] == ["FI: [1]: 3", "FI: [2]: 4", "FI: [3]: 3"]


def test_counts_only(spark, tmp_path, capsys):
    path = tmp_path / "t.txt"
    path.write_text("1 2 3\n1 2\n2 3\n1 2 3\n")
    cli.main(["FIN", "--run-type", "SEQ_SPARK", "--input-file-name", str(path), "--min-supp", "0.5"])
    assert "Total results: 7" in capsys.readouterr().out
    cli.main(["BIG_FIM", "--input-file-name", str(path), "--min-supp", "0.5"])
    assert "Total results: 7 (Apriori: 7, Eclat: 0)" in capsys.readouterr().out
