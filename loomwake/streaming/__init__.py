"""loomwake.streaming"""
