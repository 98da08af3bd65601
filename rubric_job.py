"""Launcher for spark-submit: ``spark-submit --py-files rubric.zip rubric_job.py <command> ...``
(see ``rubric/plans/cli.py`` for the commands)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rubric.plans.cli import main  # noqa: E402

if __name__ == "__main__":
    main()
