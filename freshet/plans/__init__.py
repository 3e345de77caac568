"""Whole analyses: from a daily log to features, models, scores and forecasts."""
