"""loomwake.sources"""
