"""Command line: preprocess, finetune, deconvolute and corpus, with options or a JSON file of them."""

from __future__ import annotations

import argparse
import sys

from readloom.plans import pipelines
from readloom.session import session
from readloom.sources.tables import read_config, write_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom", description=__doc__)
    p.add_argument("--master")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *needed: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.add_argument("--config", help="a JSON file of options; those on the command line win")
        for n in needed:
            v.add_argument(f"--{n}")
        return v

    v = verb("preprocess", "f_dmr", "f_ref", "output_path", "input_file", "sc_dataset")
    v.add_argument("--split_ratio", type=lambda s: tuple(map(float, s.split(","))) if "," in s else float(s))
    v.add_argument("--n_dmrs", type=int)
    v.add_argument("--n_mers", type=int)
    v.add_argument("--methyl_caller", choices=["bismark", "dorado"])
    v.add_argument("--ignore_sex_chromo", action=argparse.BooleanOptionalAction)
    v.add_argument("--use_file_name", action=argparse.BooleanOptionalAction)
    v.add_argument("--seed", type=int)
    v = verb("finetune", "train_dataset", "output_path", "test_dataset")
    v.add_argument("--iterations", type=int)
    for name in ("steps", "warmup", "decrease", "batches", "eval_freq", "save_freq"):
        v.add_argument(f"--{name}", type=int)
    v.add_argument("--lr", type=float)
    v.add_argument("--loss", choices=["cross_entropy", "focal"])
    v = verb("deconvolute", "model_dir", "input_data", "output_path", "train_dataset")
    v.add_argument("--n_grid", type=int)
    v.add_argument("--adjustment", action=argparse.BooleanOptionalAction)
    v = verb("corpus", "f_ref", "output_path")
    v.add_argument("--seq_len", type=int)
    v.add_argument("--k", type=int)
    return p


def options(argv: list[str]) -> tuple[str, str | None, dict[str, object]]:
    """The verb, the master and the options, of which unset ones are left to their defaults."""
    given = vars(parser().parse_args(argv))
    verb, master, config = given.pop("verb"), given.pop("master"), given.pop("config")
    return verb, master, (read_config(config) if config else {}) | {k: v for k, v in given.items() if v is not None}


def main(argv: list[str] | None = None) -> int:
    verb, master, values = options(sys.argv[1:] if argv is None else argv)
    spark = session(master=master)
    getattr(pipelines, verb)(spark, **values)
    if ":" not in str(values.get("output_path", "")).split("/")[0] and verb != "corpus":
        write_config(values, f"{values['output_path']}/{verb}_options.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
