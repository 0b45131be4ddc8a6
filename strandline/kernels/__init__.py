"""Numpy kernels for dynamic programming, trees and multiple alignment; Spark runs them in Arrow batches."""
