"""loomwake.operators"""
