"""Rendering of six-operator FM records and the features that are measured on the sound."""
