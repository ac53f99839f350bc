"""Relational sequence, signal, clock, evidence, planning and rendering operators."""
