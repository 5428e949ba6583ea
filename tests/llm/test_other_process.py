"""Corpus operators on workers that cannot import the package, from another folder."""

import pytest

from tests.test_entry import ROOT, RUN, alone


@pytest.mark.parametrize("names", [["op3_class_kneser_ney", "op7_perplexity_bands"], ["op9_license_index", "op12_kneser_ney_language", "op13_zfast_trie"], ["op8_html_blocks", "op11_dynamic_phrases"]])
def test_workers_need_no_package(tmp_path, names):
    code = RUN.format(root=ROOT, names=names).replace(".count() > 0, name", ".count() >= 0, name")
    done = alone(code, tmp_path)
    assert "all ran" in done.stdout, done.stderr[-3000:]
