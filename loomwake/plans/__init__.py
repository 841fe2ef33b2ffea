"""loomwake.plans"""
