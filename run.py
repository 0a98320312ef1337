"""Entry script for spark-submit; see ``garimpo/plans/job.py`` for the steps."""

from garimpo.plans.job import main

if __name__ == "__main__":
    main()
