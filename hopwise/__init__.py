"""hopwise: contact tracing over check-in trajectories, written as Spark plans."""

__version__ = "0.1.0"
