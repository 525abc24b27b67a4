"""Panel analytics on Spark: own-baseline change detection, bounded review queues, replayed logs."""

from steadyline.config import DEFAULT_POLICY, Policy

__all__ = ["DEFAULT_POLICY", "Policy"]
