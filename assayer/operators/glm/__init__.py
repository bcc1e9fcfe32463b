"""Generalised linear models by distributed sufficient statistics."""

from assayer.operators.glm.model import GLM

__all__ = ["GLM"]
