"""Command line: ``python -m ionlake.cli predict|library|single|vectors|train ...``."""

from __future__ import annotations

import argparse
import sys

import pandas as pd
from pyspark.sql import SparkSession

from .plans.config import LibraryConfig, PredictionConfig, load_config, model
from .plans.boosting import BoostParams
from .plans.metrics import RunMetrics
from .plans.models import load_model, read_nodes, save_model
from .plans.pipeline import build_library, evaluate, feature_vectors, label_of, match_spectra, median_correlations, predict, predict_one, with_targets
from .plans.training import SEARCHED, train_model, write_training
from .plans.trees import toy_nodes
from .plans.vectors import read_vectors, write_vectors
from .sinks.libraries import predictions_and_targets, write_results, write_table
from .sources.peptides import read_fasta, read_peprec
from .sources.spectra import read_spectra


def _nodes(spark: SparkSession, files: list[str] | None, name: str, folder: str | None) -> pd.DataFrame:
    """A model's trees: from files, else from the model folder, else the toy forest."""
    own = model(name)
    if files:
        return read_nodes(spark, files, own.name, own.ions)
    return load_model(spark, name, folder) if folder else toy_nodes(tuple(own.ions))


NODES = "trees: node tables (.parquet), source (.c), or boosted models of one ion type, as in B=b.json Y=y.txt; without them the configured model folder, else a toy forest"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ionlake")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("predict", help="spectra of a peptide file")
    p.add_argument("peptides")
    p.add_argument("-c", "--config")
    p.add_argument("-s", "--spectra", help="observed spectra to compare with")
    p.add_argument("-x", "--correlations", action="store_true", help="write correlations")
    p.add_argument("-m", "--match", action="store_true", help="match spectra by precursor and peaks")
    p.add_argument("-i", "--spectrum-id-pattern", default="(.*)")
    p.add_argument("-n", "--nodes", nargs="*", help=NODES)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-f", "--formats", nargs="*")
    p = commands.add_parser("library", help="spectral library of a FASTA file")
    p.add_argument("fasta")
    p.add_argument("-c", "--config")
    p.add_argument("-n", "--nodes", nargs="*", help=NODES)
    p.add_argument("--model-dir", help="folder of model files with models.json")
    p.add_argument("-o", "--output", required=True)
    p = commands.add_parser("single", help="spectrum of one peptide")
    p.add_argument("peptide")
    p.add_argument("modifications")
    p.add_argument("charge", type=int)
    p.add_argument("-c", "--config")
    p.add_argument("-n", "--nodes", nargs="*", help=NODES)
    p = commands.add_parser("vectors", help="feature vectors with observed targets, as a table by charge")
    p.add_argument("peptides")
    p.add_argument("spectra")
    p.add_argument("-c", "--config")
    p.add_argument("-i", "--spectrum-id-pattern", default="(.*)")
    p.add_argument("-o", "--output", required=True)
    p = commands.add_parser("train", help="forests of a model from a vector table")
    p.add_argument("vectors")
    p.add_argument("model")
    p.add_argument("-i", "--ions", nargs="*", help="ion types; the model's own without")
    p.add_argument("-t", "--trees", type=int, default=30)
    p.add_argument("-e", "--evaluate", nargs="*", default=[], help="further vector tables, as name=path")
    p.add_argument("-g", "--search", action="store_true", help="take the parameters from a cross-validated search")
    p.add_argument("--min-rows", type=int, default=50, help="rows of a leaf")
    p.add_argument("--model-dir", help="model folder that gets the forests")
    p.add_argument("-o", "--output", required=True)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("ionlake").getOrCreate()
    try:
        if args.command == "library":
            config = LibraryConfig.load(args.config) if args.config else LibraryConfig()
            nodes = _nodes(spark, args.nodes, config.model, args.model_dir)
            build_library(read_fasta(spark, args.fasta), nodes, config, path=args.output)
            return 0
        if args.command == "train":
            own = model(args.model)
            evals = {name: read_vectors(spark, path) for name, _, path in (e.partition("=") for e in args.evaluate)}
            params = BoostParams(trees=args.trees, min_rows=args.min_rows)
            trained = train_model(read_vectors(spark, args.vectors), args.ions or own.ions, own.name, params, evals, search=SEARCHED if args.search else None)
            write_training(trained, args.output)
            if args.model_dir:
                save_model(spark, pd.concat([t.fitted.nodes for t in trained], ignore_index=True), own.name, args.model_dir)
            return 0
        config = load_config(args.config) if args.config else PredictionConfig()
        own = model(config.model)
        if args.command == "vectors":
            peprec, spectra = read_peprec(spark, args.peptides), read_spectra(spark, args.spectra)
            targets = with_targets(peprec, spectra, config.catalogue(), own.version, config.frag_error, args.spectrum_id_pattern, label_of(own.name))
            write_vectors(feature_vectors(peprec, targets), args.output, own.ions)
            return 0
        nodes = _nodes(spark, args.nodes, config.model, config.model_dir)
        if args.command == "single":
            predict_one(spark, args.peptide, args.modifications, args.charge, nodes, config.catalogue(), own.version).show(200, False)
            return 0
        peprec, metrics = read_peprec(spark, args.peptides), RunMetrics()
        predictions = predict(peprec, nodes, config.catalogue(), own.version, metrics=metrics)
        metrics.check_records()
        if args.spectra:
            spectra = read_spectra(spark, args.spectra)
            if args.match:
                write_table(match_spectra(predictions, peprec, spectra, config.catalogue(), peak_tolerance=config.frag_error), args.output + "_matched.csv")
                return 0
            targets = with_targets(peprec, metrics.watch_spectra(spectra), config.catalogue(), own.version, config.frag_error, args.spectrum_id_pattern, label_of(own.name))
            write_table(predictions_and_targets(predictions, targets), args.output + "_pred_and_emp.csv")
            seen = metrics.check_spectra()
            print(f"{seen['spectra']} spectra, {seen['empty']} without peaks, {seen['spectra_per_task']:.0f} a task", file=sys.stderr)
            if args.correlations:
                correlations = evaluate(predictions, targets)
                write_table(correlations, args.output + "_correlations.csv")
                median_correlations(correlations).show()
            return 0
        write_results(predictions, peprec, args.output, args.formats or config.out, catalogue=config.catalogue())
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
