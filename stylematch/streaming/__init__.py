"""Structured Streaming: rating basket, rating log, weight re-fit."""
