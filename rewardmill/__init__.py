"""Spark-native data engine for reinforcement-learning post-training.

Curation, rollout scoring, group statistics, token-level losses, sampling and
benchmark evaluation, each as DataFrame -> DataFrame functions.
"""
