"""Reusable distributed plans: ranking, quantiles, folds, graph and neighbour joins."""
