"""python -m kmerloom [config.toml]: runs the search that a configuration describes; python -m kmerloom COMMAND ...: one of the pipelines around it."""

import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kmerloom import pipelines
from kmerloom.functions import sequence as S
from kmerloom.operators import search
from kmerloom.sources import config as configs
from kmerloom.sources import fasta, sinks

log = logging.getLogger("kmerloom")


def run(spark: SparkSession, config: configs.Config) -> None:
    files = fasta.references(spark, config.ref_dir)
    records = fasta.read(spark, files)
    queries = fasta.queries(fasta.read(spark, config.query_file)).persist()
    if not queries.take(1):
        raise ValueError("no queries")
    refs = sorted(fasta.ref_id(f) for f in files)
    log.info("%d references, %d queries", len(refs), queries.count())
    k, out = config.kmer_size, config.output_dir
    fragments = search.fragment_table(records, k, config.fragment_size)
    length = F.length(S.normalize(F.col("seq"), k))
    longest = records.agg(F.max(F.least(F.nullif(length, F.lit(0)), F.lit(config.fragment_size)))).first()[0]
    if longest is None:
        raise ValueError("no fragments")
    if config.index_method == "ibf" and longest < k:
        raise ValueError("kmer_size must be > 0 and <= the longest fragment")
    kmers = search.query_kmers(queries, k)
    if config.store_index:
        sinks.save_index(search.build_index(fragments, k), f"{out}/index")
        index = sinks.load_index(spark, f"{out}/index")
    else:
        index = search.build_index(fragments, k, only=kmers)
    hits = search.probe(kmers, index).persist()
    grid = search.pairs(queries, spark.createDataFrame([(r,) for r in refs], "ref_id string"), k)
    results = search.aggregate(hits, grid, config.hit_threshold)
    if config.single_results_writer:
        sinks.combined_results(results, refs, f"{out}/{config.output_file or 'results.tsv'}")
    else:
        sinks.per_reference_results(results, f"{out}/results")
    sinks.unique_kmer_table(search.unique_kmers(hits, grid), f"{out}/unique_mers")
    sinks.kmer_list_table(search.hit_lists(hits, grid), f"{out}/kmers")
    if config.store_fragments:
        sinks.fragment_fasta(fragments, f"{out}/fragments")
    if config.store_index and config.cleanup_index:
        sinks.remove(spark, f"{out}/index")
    hits.unpersist()
    queries.unpersist()


def session(threads: int = 0) -> SparkSession:
    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads or '*'}]")).appName("kmerloom").getOrCreate()


def main(arguments: list[str]) -> int:
    """The search of a configuration file, or one of the commands of pipelines.py."""
    try:
        if arguments and arguments[0] in pipelines.COMMANDS:
            options = pipelines.parser().parse_args(arguments)
            pipelines.COMMANDS[options.command](session(options.threads), options)
            return 0
        path = arguments[0] if arguments else "config.toml"
        config = configs.load(path)
        if config.log_file:
            os.makedirs(os.path.dirname(config.log_file) or ".", exist_ok=True)
            logging.basicConfig(filename=config.log_file, level=logging.INFO, format="[%(levelname)s] %(asctime)s %(message)s", datefmt="%Y-%m-%d %H:%M:%S")
        run(session(config.threads), config)
    except (OSError, ValueError) as e:
        log.error("%s", e)
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
