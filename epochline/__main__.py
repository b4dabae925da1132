"""Run one stage: `python -m epochline star|views|models|reports …`."""

from __future__ import annotations

import argparse

from epochline.plans import flow
from epochline.plans.config import FlowConfig
from epochline.session import build_session, drop_scratch
from epochline.sources.inputs import InputPaths, read_inputs


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="epochline")
    parser.add_argument("stage", choices=["star", "views", "models", "reports"])
    parser.add_argument("--inputs", help="folder with the source tables (star)")
    parser.add_argument("--star", help="folder with the star schema (views)")
    parser.add_argument("--views", help="folder with the views (models, reports)")
    parser.add_argument("--models", help="folder with the predictions (reports)")
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", help="JSON document with the settings")
    parser.add_argument("--master", help="Spark master, if spark-submit does not set it")
    options = parser.parse_args(arguments)

    config = FlowConfig.from_document(options.config) if options.config else FlowConfig()
    spark = build_session(master=options.master)
    try:
        if options.stage == "star":
            flow.run_star(read_inputs(spark, InputPaths.in_folder(options.inputs)), options.out)
        elif options.stage == "views":
            flow.run_views(spark, options.star, options.out, config)
        elif options.stage == "models":
            flow.run_models(spark, options.views, options.out, config).show(truncate=False)
        else:
            flow.run_reports(spark, options.views, options.models, options.out, config)
    finally:
        drop_scratch(spark)


if __name__ == "__main__":
    main()
