"""fathomline.operators"""
