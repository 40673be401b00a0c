"""python -m lumenspan run CONFIG | check CONFIG"""

from __future__ import annotations

import json
import logging
import sys

from lumenspan.sources import config


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("run", "check"):
        print(__doc__)
        return 2
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    cfg = config.load(args[1])
    if args[0] == "check":
        print(json.dumps(config.as_dict(cfg), indent=2, default=str))
        return 0
    from pyspark.sql import SparkSession

    from lumenspan.plans.experiment import Experiment

    e = Experiment(SparkSession.builder.appName(cfg.execution.experiment_name).getOrCreate(), cfg)
    result = e.run()
    e.persist(result)
    print(json.dumps(result.report, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
