"""Cladeframe: character matrices, trees and likelihoods as Spark DataFrames."""
